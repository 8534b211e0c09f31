import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.chunk import chunk_documents
from corpusmill.operators.entities import PATTERNS, extract_entities


def expected_chunks(text, limit):
    """The packing rule, said once more in Python: pieces with the run they belong to."""
    text = text.strip()
    if len(text) <= limit:
        return [text]
    pieces = []
    for number, paragraph in enumerate(filter(None, (p.strip() for p in re.split(r"\n\s*\n", text)))):
        if len(paragraph) > limit:
            pieces += [(s, " ", number) for s in re.split(r"(?<=[.!?])\s+", paragraph)]
        else:
            pieces.append((paragraph, "\n\n", None))
    chunks, open_run = [], "none"
    for piece, glue, run in pieces:
        if chunks and run == open_run and len(chunks[-1]) + len(piece) + 1 <= limit:
            chunks[-1] += glue + piece
        else:
            chunks.append(piece)
        open_run = run
    return chunks


TEXTS = [
    "Short text.",
    "",
    "   padded   ",
    "Paragraph one. " * 20 + "\n\n" + "Paragraph two. " * 20,
    "Tiny.\n\nSmall.\n \n" + "Long sentence here! " * 30 + "\n\nAfter.\n\nEnd.",
    "x" * 900,
    "A one. " + "y" * 400 + ". Next? " + "z" * 99 + "! Last.",
    "a" * 200 + "\n\n" + "b" * 199 + "\n\n" + "c",
]


@pytest.mark.parametrize("limit", [50, 200, 500])
def test_chunks(docs, limit):
    chunks = chunk_documents(docs(TEXTS), max_chunk_size=limit)
    found = {}
    for row in sorted(chunks.collect(), key=lambda r: (r["doc_id"], r["chunk_index"])):
        found.setdefault(row["doc_id"], []).append(row["content"])
    assert [found[i] for i in range(len(TEXTS))] == [expected_chunks(t, limit) for t in TEXTS]


def test_paragraph_chunk_may_be_one_over(docs):
    chunks = chunk_documents(docs(["a" * 100 + "\n\n" + "b" * 99 + "\n\n" + "c" * 100]), max_chunk_size=200)
    assert max(r["n"] for r in chunks.select(F.length("content").alias("n")).collect()) == 201


ENTITY_TEXTS = [
    "Contact alice@example.com for details.",
    "Meeting on 2026-03-07 at noon, not 2026/3/7 but 2026/04/08.",
    "Revenue was $1,234,567.89 in Q4; $5 and $99.99.",
    "See https://a.b/c?d=e and http://x\tnow; call 555-123-4567, 5551234567 or 555-1234.",
    "é https://ü.de/ä ünï@example.org 5551234567é ٠١٢٣-٤٥-٦٧",
    "nothing here",
    "a@b.co" + " c@d.org" * 5,
]


def test_entities_with_offsets(docs):
    found = {
        (r["doc_id"], r["label"], r["text"], r["start"], r["end"]) for r in extract_entities(docs(ENTITY_TEXTS)).collect()
    }
    expected = {
        (i, label, m.group(), m.start(), m.end())
        for i, text in enumerate(ENTITY_TEXTS)
        for label, (pattern, _) in PATTERNS.items()
        for m in re.finditer(pattern, text)
    }
    assert found == expected


def test_extra_patterns(docs):
    rows = extract_entities(docs(["order #42 and #7"]), extra_patterns={"ORDER": r"#\d+"}).collect()
    assert [(r["label"], r["text"], r["start"]) for r in rows] == [("ORDER", "#42", 6), ("ORDER", "#7", 14)]
