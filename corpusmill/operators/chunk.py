"""Split documents into chunks along paragraphs, and along sentences where a paragraph is too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import WHITESPACE, bound, strip

PARAGRAPH_GAP = rf"\n{WHITESPACE}*\n"
SENTENCE_GAP = rf"(?<=[.!?]){WHITESPACE}+"


def _pieces(text: Column, limit: int) -> Column:
    """Paragraphs in order, over-long ones as sentences.

    ``run`` tells which pieces may share a chunk: whole paragraphs with each other (-1), sentences
    only with those of their own paragraph (its number). ``glue`` goes between two of them.
    """

    def sentences(paragraph: Column, number: Column) -> Column:
        return F.transform(
            F.split(paragraph, SENTENCE_GAP),
            lambda s: F.struct(s.alias("text"), F.length(s).alias("size"), F.lit(" ").alias("glue"), number.alias("run")),
        )

    def whole(paragraph: Column) -> Column:
        return F.array(
            F.struct(
                paragraph.alias("text"), F.length(paragraph).alias("size"), F.lit("\n\n").alias("glue"), F.lit(-1).alias("run")
            )
        )

    paragraphs = F.filter(F.transform(F.split(text, PARAGRAPH_GAP), strip), lambda p: p != "")
    return F.flatten(
        F.transform(paragraphs, lambda p, i: F.when(F.length(p) > limit, sentences(p, i)).otherwise(whole(p)))
    )


def chunk_texts(content: Column, max_chunk_size: int = 1000) -> Column:
    """Array of chunk texts. Greedy: a piece joins the open chunk while both and one more character
    fit, so a chunk of paragraphs may be one over the limit and a lone sentence stays whole."""

    def step(state: Column, piece: Column) -> Column:
        size = state["size"] + piece["size"]
        fits = (state["run"] == piece["run"]) & (size + 1 <= max_chunk_size)
        nothing_open = state["size"] == 0
        joined = F.struct(
            state["done"].alias("done"),
            F.concat(state["open"], piece["glue"], piece["text"]).alias("open"),
            (size + F.length(piece["glue"])).alias("size"),
            state["run"].alias("run"),
        )
        started = F.struct(
            F.when(nothing_open, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
            piece["text"].alias("open"),
            piece["size"].alias("size"),
            piece["run"].alias("run"),
        )
        return F.when(fits & ~nothing_open, joined).otherwise(started)

    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("open"),
        F.lit(0).alias("size"),
        F.lit(-1).alias("run"),
    )

    def split(text: Column) -> Column:
        packed = F.aggregate(
            _pieces(text, max_chunk_size), start, step, lambda state: F.concat(state["done"], F.array(state["open"]))
        )
        return F.when(F.length(text) <= max_chunk_size, F.array(text)).otherwise(packed)

    return bound(strip(content), split)


def chunk_documents(documents: DataFrame, *, max_chunk_size: int = 1000, content: str = "content") -> DataFrame:
    """One row per chunk with its number in the document; other columns are carried along."""
    carried = [c for c in documents.columns if c != content]
    return documents.select(
        *carried, F.posexplode(chunk_texts(F.col(content), max_chunk_size)).alias("chunk_index", content)
    )
