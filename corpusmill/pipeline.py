"""The whole preparation as one lazy plan: clean, split, find entities, score, render."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpusmill.operators.chunk import chunk_documents
from corpusmill.operators.clean import CleanOptions, clean, clean_report
from corpusmill.operators.detect import render_detected
from corpusmill.operators.entities import extract_entities
from corpusmill.operators.quality import score_quality


@dataclass(frozen=True)
class Prepared:
    documents: DataFrame
    report: DataFrame
    chunks: DataFrame
    entities: DataFrame
    quality: DataFrame
    records: DataFrame


def prepare(
    documents: DataFrame,
    options: CleanOptions = CleanOptions(collapse_newlines=False),
    *,
    by: Sequence[str] = (),
    max_chunk_size: int = 1000,
    catalog: DataFrame | None = None,
    database: str | None = None,
) -> Prepared:
    """From documents (doc_id, content, source_ref) to training records.

    Cleaning comes before splitting and leaves blank lines alone, since paragraphs end there.
    ``by`` names the corpus columns; ``catalog`` lets the schema of ``database`` choose the record format.
    """
    cleaned = clean(documents, options, corpus=by)
    chunks = chunk_documents(cleaned, max_chunk_size=max_chunk_size)
    return Prepared(
        documents=cleaned,
        report=clean_report(documents, options, corpus=by),
        chunks=chunks,
        entities=extract_entities(chunks),
        quality=score_quality(chunks, by=by),
        records=render_detected(chunks, catalog, database=database),
    )
