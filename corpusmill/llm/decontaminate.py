"""Benchmark decontamination by the q-gram lemma.

Texts and passages are compared as normal text: lower case, runs of anything but letters and digits as one space. If a passage
of m characters occurs in a text with at most e edits, they share at least ``m + 1 - q (e + 1)`` q-grams whose
diagonals (place in the text less place in the passage) lie within e of each other. Shared q-grams are counted in overlapping
bands of diagonals, regions that reach the bound are kept, and a banded alignment of the whole passage verifies them. Texts
are searched many at a time; a region that touches several is aligned with each of them by itself.

Passages longer than ``SEGMENT`` are cut into overlapping segments; each is searched by itself. The passages are
taken in blocks of bounded size; every block meets every text, so the table of passages may grow.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
#: One edit is allowed for so many characters of a segment.
CHARS_PER_EDIT = 12
SEGMENT = 400
BAND = 64
BLOCK_CHARS = 1 << 20
CHUNK_CHARS = 1 << 20
FOUND = "doc_id long, item_id long, start long, end long, edits long"

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter or number; built once in a process."""
    table = np.ones(0x110000, dtype=bool)
    codes = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    for found in _OTHER.finditer(codes.tobytes().decode("utf-32-le")):
        table[codes[found.start() : found.end()]] = False
    table[0xD800:0xE000] = False
    return table


def normal_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the normal forms of texts, one line break between two, and where each begins."""
    lowered = [t.lower() for t in texts]
    codes = _codes("\n".join(lowered))
    breaks = np.cumsum([len(t) + 1 for t in lowered[:-1]], dtype=np.int64) - 1
    letters = _letters()[codes]
    # Of a run of other characters the one behind a letter stays, as a space, and line breaks between texts do.
    kept = letters.copy()
    kept[1:] |= letters[:-1]
    kept[breaks] = True
    codes = np.where(letters, codes, np.uint32(32))
    codes[breaks] = 10
    at = np.cumsum(kept, dtype=np.int64)[breaks] - 1  # where the breaks stand now
    codes = codes[kept]
    # Spaces at the end of a text go.
    last = np.r_[at, len(codes)] - 1
    last = last[last >= 0]
    trailing = last[codes[last] == 32]
    return np.delete(codes, trailing), np.r_[0, at + 1 - np.searchsorted(trailing, at)].astype(np.int64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``Q`` characters at every place that has as many left: a polynomial, put together from those of halves."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = lambda k: np.uint64(pow(int(_BASE), k, 1 << 64))
    part, width = codes.astype(np.uint64), 1
    out, done = None, 0  # the hash of the first ``done`` characters
    while True:
        if Q & width:
            ahead = part[done : done + n]
            out = ahead.copy() if out is None else out * power(width) + ahead
            done += width
        if done == Q:
            break
        part = part[:-width] * power(width) + part[width:]
        width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def edit_budget(m: int) -> int:
    """Edits allowed for m characters: fewer for short passages, so that at least one shared q-gram is required."""
    return max(0, min(m // CHARS_PER_EDIT, (m - Q) // Q))


class Passages:
    """A q-gram index of one block of passages. Those shorter than ``Q`` characters are matched as whole words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.id = uuid.uuid4().hex
        self.segments: list[tuple[int, str]] = []
        self.short: list[tuple[int, str]] = []
        for item_id, text in items:
            if len(text) < Q:
                self.short += [(item_id, text)] if text else []
                continue
            step = SEGMENT // 2
            starts = range(0, max(1, len(text) - SEGMENT + step), step) if len(text) > SEGMENT else (0,)
            self.segments += [(item_id, text[s : s + SEGMENT]) for s in starts if len(text[s : s + SEGMENT]) >= Q]
        grams = [_grams(_codes(t)) for _, t in self.segments]
        sizes = [len(g) for g in grams]
        all_grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes])[order] if sizes else np.zeros(0, dtype=np.int64)
        self.there = np.zeros(1 << _BITS, dtype=bool)
        self.there[self.grams >> np.uint64(64 - _BITS)] = True
        lengths = np.array([len(t) for _, t in self.segments], dtype=np.int64)
        self.edits = np.array([edit_budget(m) for m in lengths], dtype=np.int64)
        self.needed = np.maximum(1, lengths + 1 - Q * (self.edits + 1))

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, band) of every region that reaches its bound; a band starts at diagonal ``band * BAND``."""
        grams = _grams(codes)
        at = np.flatnonzero(self.there[grams >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.grams):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[slot] == grams[at]
        at, slot = at[same], slot[same]
        times = self.count[slot]
        posting = np.repeat(self.first[slot] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        owner, diagonal = self.owner[posting], np.repeat(at, times) - self.place[posting]
        band = diagonal // BAND
        lower = (diagonal - self.edits[owner]) // BAND  # the band before, if its overlap reaches this diagonal
        owner, band = np.r_[owner, owner[lower < band]], np.r_[band, lower[lower < band]]
        shift = int(band.min(initial=0))
        width = int(band.max(initial=0)) - shift + 1
        keys, hits = np.unique(owner * width + (band - shift), return_counts=True)
        kept = keys[hits >= self.needed[keys // width]]
        return kept // width, kept % width + shift

    def search(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item_id, start, end, edits) of verified regions, each text that a region touches by itself; ``starts``: where each text begins in ``codes``."""
        ends = np.r_[starts[1:] - 1, len(codes)]  # one character stands between two texts
        for segment, band in zip(*(x.tolist() for x in self.regions(codes))):
            item_id, passage = self.segments[segment]
            budget, m = int(self.edits[segment]), len(passage)
            low, high = max(0, band * BAND - budget), (band + 1) * BAND + m + 2 * budget
            letters = _codes(passage)
            for text in range(int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, high))):
                first, last = max(low, int(starts[text])), min(high, int(ends[text]))
                if last - first < m - budget:
                    continue
                found = align(letters, codes[first:last], budget, BAND + 3 * budget)
                if found:
                    edits, start, end = found
                    start, end = (first - int(starts[text]) + k for k in (start, end))
                    yield text, item_id, start, end, edits


def align(passage: np.ndarray, region: np.ndarray, budget: int, band: int) -> tuple[int, int, int] | None:
    """The whole passage against any part of the region: (edits, start, end) of the best place, or None beyond the budget.

    Row i of the table holds the cells whose diagonal (place in the region less i) is from -budget to ``band``.
    """
    width = band + 2 * budget + 1
    padded = np.full(budget + len(region) + len(passage) + width, -1, dtype=np.int64)
    padded[budget : budget + len(region)] = region
    far = 1 << 20
    columns = np.arange(width)
    row = np.where(columns < budget, far, 0)  # before the region's start nothing can begin
    start = np.maximum(columns - budget, 0)
    for i, letter in enumerate(passage.tolist()):
        # cell c of row i stands behind the region's first c - budget + i characters
        across = row + (padded[i : i + width] != letter)
        down, down_from = np.r_[row[1:] + 1, far], np.r_[start[1:], 0]
        best = np.minimum(across, down)
        origin = np.where(across <= down, start, down_from)
        run = best - columns
        lead = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == lead, columns, 0))
        row, start = lead + columns, origin[source]
        if row.min() > budget:
            return None
    last = np.minimum(columns - budget + len(passage), len(region))
    beyond = columns - budget + len(passage) > len(region)
    row = np.where(beyond, far, row)
    best = int(row.argmin())
    return (int(row[best]), int(start[best]), int(last[best])) if row[best] <= budget else None


def _original(text: str, places: list[int]) -> list[int]:
    """Where characters of the normal text stand in the text itself, in code points."""
    origin: list[int] = []
    for k, letter in enumerate(text):
        for low in letter.lower():
            if _OTHER.match(low):
                if origin and origin[-1] >= 0:
                    origin.append(-1 - k)
            else:
                origin.append(k)
    fixed = [k if k >= 0 else -1 - k for k in origin]
    return [fixed[min(max(p, 0), len(fixed) - 1)] for p in places]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = value.as_py()
            if text:
                ids.append(key)
                texts.append(text)
                size += len(text)
            if size > CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    yield ids, texts


def _search_block(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(block)
        for ids, texts in _chunks(batches):
            if not texts:
                continue
            codes, starts = normal_codes(texts)
            cleaned = codes.tobytes().decode("utf-32-le").split("\n") if passages.short else []
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for text, item, start, end, edits in passages.search(codes, starts):
                key, value = (text, item), (edits, start, end)
                best[key] = min(best.get(key, value), value)
            for item, word in passages.short:
                pattern = re.compile(rf"(?<![^ ]){re.escape(word)}(?![^ ])")
                for text, value in enumerate(cleaned):
                    if found := pattern.search(value):
                        best[text, item] = (0, found.start(), found.end())
            rows = []
            for (text, item), (edits, start, end) in best.items():
                first, last = _original(texts[text], [start, end - 1])
                rows.append((ids[text], item, first, last + 1, edits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "start", "end", "edits"])

    return docs.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per doc_id and item_id found: where the best match (of a segment) stands in the text, in code points, and its edits.

    Only doc_id, text, item_id and text are read, so other columns may have any name. Null and empty texts and passages match
    nothing. Rows without doc_id are searched like others and come out without doc_id; repeated rows come out each; of
    repeated or equal passages each matches. Ties go to the earliest place. Empty tables give no rows. Texts are
    never shuffled.
    """
    rows = docs.select("doc_id", "text").where("text IS NOT NULL")
    found, block, size = [], [], 0
    for item in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        passage = normal(item["text"])
        block.append((item["item_id"], passage))
        size += len(passage)
        if size > BLOCK_CHARS:
            found.append(_search_block(rows, block))
            block, size = [], 0
    found.append(_search_block(rows, block))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    keys = F.struct("edits", "start", "end")
    return out if len(found) == 1 else out.groupBy("doc_id", "item_id").agg(F.min(keys).alias("m")).select("doc_id", "item_id", "m.start", "m.end", "m.edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose document no passage was found; rows without doc_id, which cannot be named, go."""
    found = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_anti").select(*docs.columns)
