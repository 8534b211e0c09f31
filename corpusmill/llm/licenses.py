"""License scans with a positional index of rare words.

Templates are licence statements. Every template word gets its inverse document frequency from all scanned files; a
template's rarest words are its anchors. A file's places of anchor words are turned into template offsets (place less
position in the template); an offset that enough anchors agree on is an alignment, which is accepted when the template's
mandatory phrase stands there too. Its score is the IDF-weighted share of the template's words found in place.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, statement, and a phrase that must stand in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
ANCHORS = 4
MIN_SCORE = 0.75
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _count_words(data: bytes) -> int:
    flags = _IS_WORD[np.frombuffer(data, dtype=np.uint8)]
    return int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())


def _lowered(value) -> bytes:
    return (value.as_py() or "").encode().lower()


def document_frequencies(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many files each word of ``vocabulary`` occurs, and the number of files."""
    known = {w.encode() for w in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for value in batch.column(0):
                seen.update(known.intersection(WORD.findall(_lowered(value))))
        words = ["", *(w.decode() for w in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    counted = files.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: int(r["n"]) for r in counted.collect()}  # one row per template word
    return found, found.pop("", 0)


class Index:
    """Postings of the rarest template words: word -> (template, position)."""

    def __init__(self, frequencies: dict[str, int], files: int, templates=TEMPLATES, base=BASE):
        self.templates = [(label, tuple(t.encode().split()), tuple(p.encode().split())) for label, t, p in templates]
        self.base = [(tuple(p.encode().split()), label) for p, label in base.items()]
        idf = lambda w: math.log((1 + files) / (1 + frequencies.get(w.decode(), 0))) + 1e-3
        self.idf = {w: idf(w) for _, words, _ in self.templates for w in words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors = []
        for k, (_, words, _) in enumerate(self.templates):
            rarest = sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], i))[:ANCHORS]
            self.anchors.append(len(rarest))
            for i in rarest:
                self.postings[words[i]].append((k, i))
        self.rare = tuple(self.postings)
        self.base_firsts = {p[0] for p, _ in self.base}

    def may_hold(self, data: bytes) -> bool:
        """False if no base phrase and no anchor word can be there: every template has its rarest word as an anchor."""
        return any(w in data for w in self.rare) or any(all(w in data for w in p) for p, _ in self.base)

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        out = []
        at = [i for i, w in enumerate(words) if w in self.base_firsts]
        for phrase, label in self.base:
            out += [(i, label) for i in at if tuple(words[i : i + len(phrase)]) == phrase]
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(place, label, score) of every accepted alignment."""
        votes: Counter[tuple[int, int]] = Counter()
        for place, word in enumerate(words):
            for k, i in self.postings.get(word, ()):
                votes[k, place - i] += 1
        out = []
        for (k, start), n in votes.items():
            label, template, phrase = self.templates[k]
            if 2 * n < self.anchors[k]:
                continue
            first = max(0, start)
            window = words[first : start + len(template)]
            if not any(tuple(window[j : j + len(phrase)]) == phrase for j in range(len(window) - len(phrase) + 1)):
                continue
            here = sum(self.idf[t] for j, t in enumerate(template) if 0 <= start + j < len(words) and words[start + j] == t)
            score = here / sum(self.idf[t] for t in template)
            if score >= MIN_SCORE:
                out.append((first, label, min(1.0, score)))
        return out


def scan(files: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per file: word count, places of base phrases, base labels, all labels, and the best score.

    Only doc_id and text are read, so other columns may have any name. Null and empty texts have no words, no labels and
    score 0. A base phrase scores 1. Rows without doc_id and repeated rows are scanned each. An empty table gives no rows.
    """
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    frequencies, n = document_frequencies(files, vocabulary, text)
    index = Index(frequencies, n, templates, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _lowered(value)
                if not index.may_hold(data):
                    rows.append((key, _count_words(data), 0, None, None, "", "", 0.0))
                    continue
                words = WORD.findall(data)
                places = index.base_places(words)
                found = index.matches(words)
                at = [p for p, _ in places]
                labels = {label for _, label in places}
                score = max([1.0 if places else 0.0, *(s for _, _, s in found)])
                both = labels | {label for _, label, _ in found}
                rows.append((key, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), score))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*rows) if rows else [[]] * 8
            names = [c.split()[0] for c in SCANNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return files.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCANNED)
