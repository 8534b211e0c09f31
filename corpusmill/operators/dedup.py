"""Exact duplicates: the first copy in input order stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(content: str, within: Sequence[str]):
    return [*[F.col(c) for c in within], F.md5(F.col(content)).alias("_digest")]


def first_copies(
    df: DataFrame, *, content: str = "content", order_by: Sequence[str] = ("doc_id",), within: Sequence[str] = ()
) -> DataFrame:
    """The ``order_by`` values of each first copy. Only digests and keys are shuffled."""
    first = F.min(F.struct(*order_by)).alias("_first")
    return df.groupBy(*_keys(content, within)).agg(first).select("_first.*")


def drop_exact_duplicates(
    df: DataFrame, *, content: str = "content", order_by: Sequence[str] = ("doc_id",), within: Sequence[str] = ()
) -> DataFrame:
    """Keep the first copy of each text.

    A grouped minimum rather than a window: map tasks merge their copies before the shuffle, so a
    text that fills a third of the rows arrives as one row per map task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(row, F.struct(*order_by)).alias("_row")
    return df.groupBy(*_keys(content, within)).agg(first).select("_row.*")


def drop_known(df: DataFrame, known: DataFrame, *, content: str = "content", known_content: str = "content") -> DataFrame:
    """Drop texts that an existing corpus already holds. A digest that very many rows share is split by adaptive execution."""
    digests = known.select(F.md5(F.col(known_content)).alias("_digest")).distinct()
    marked = df.withColumn("_digest", F.md5(F.col(content)))
    return marked.join(digests, "_digest", "left_anti").drop("_digest")
