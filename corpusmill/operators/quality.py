"""Corpus quality score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bound, count_char, strip


def noise(text: Column) -> Column:
    """Short texts, and texts that are mostly blanks, count as noise."""
    size = F.greatest(F.length(text), F.lit(1))
    return bound(strip(text), lambda s: (F.length(s) < 20) | (count_char(s, " ") / size > 0.5))


def score_quality(chunks: DataFrame, *, by: Sequence[str] = (), content: str = "content") -> DataFrame:
    """One row per corpus. The distinct count is planned as a first grouping on (corpus, digest),
    so a corpus that holds most rows is still spread over all tasks."""
    text = F.col(content)
    noisy = noise(text)
    slim = chunks.select(
        *by,
        F.md5(text).alias("_digest"),
        noisy.cast("int").alias("_noisy"),
        F.length(text).alias("_length"),
    )
    totals = slim.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_distinct("_digest").alias("unique_chunks"),
        F.sum("_noisy").alias("_noisy"),
        F.sum("_length").alias("_chars"),
    )
    total = F.col("total_chunks")
    empty = total == 0
    scored = totals.select(
        *by,
        "total_chunks",
        "unique_chunks",
        F.when(empty, 0.0).otherwise(1.0 - F.try_divide("unique_chunks", total)).alias("duplicate_ratio"),
        F.when(empty, 0.0).otherwise(F.try_divide("_noisy", total)).alias("noise_ratio"),
        F.when(empty, 0.0)
        .otherwise(F.least(F.try_divide(F.try_divide("_chars", total), F.lit(500.0)), F.lit(1.0)))
        .alias("coverage"),
    )
    overall = (
        (1.0 - F.col("duplicate_ratio")) * 0.4 + (1.0 - F.col("noise_ratio")) * 0.3 + F.col("coverage") * 0.3
    )
    return scored.withColumn("overall", F.when(empty, 0.0).otherwise(overall))
