"""Exact latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.numbers import round_half_even

PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
RESOLUTION = 4096
EXACT = "decimal(38,9)"  # sums of it do not depend on the order of rows
LARGEST = 1e17  # beyond it a duration counts in the percentiles, and the mean is null


def _bucket(value: Column) -> Column:
    """A number that never falls as ``value`` rises, fine in relative terms."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * RESOLUTION).cast("long")


def latency_stats(durations: DataFrame, *, by: Sequence[str] = ("model_id",), value: str = "duration_ms") -> DataFrame:
    """p50, p95, p99 by linear interpolation, and the mean; rounded to 2 places.

    Durations are counted per value, then per bucket of near values. The bucket counts tell which
    few buckets hold the wanted ranks, and only their values are put in order. Nothing is
    approximated, and no task sorts all durations of a model.
    """
    values = durations.where(F.col(value).isNotNull())
    counts = values.groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_bucket", _bucket(F.col("_value")))

    product = (F.col("_value").try_cast("decimal(27,9)") * F.col("_n").cast("decimal(11,0)")).try_cast(EXACT)
    whole = Window.partitionBy(*by)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counts.groupBy(*by, "_bucket")
        .agg(F.sum("_n").alias("_rows"), F.sum(product).alias("_sum"), F.max(F.abs("_value")).alias("_most"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(whole))
        .withColumn("_most", F.max("_most").over(whole))
        .withColumn("_mean", F.when(F.col("_most") <= LARGEST, F.sum("_sum").over(whole).cast("double") / F.col("_total")))
    )
    exact = {name: (F.col("_total") - 1) * F.lit(p) for name, p in PERCENTILES.items()}
    ranks = [F.floor(k) for k in exact.values()] + [F.least(F.floor(k) + 1, F.col("_total") - 1) for k in exact.values()]

    def within(first: str, rows: str) -> Column:
        end = F.col(first) + F.col(rows)
        return F.filter(F.array(*ranks), lambda r: (r >= F.col(first)) & (r < end))

    wanted = buckets.where(F.size(within("_before", "_rows")) > 0).select(*by, "_bucket", "_before", "_total", "_mean")
    inside = Window.partitionBy(*by, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(wanted, [*by, "_bucket"]).withColumn(
        "_first", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )

    def holds(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n")), F.col("_value")))

    found = placed.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        F.max("_mean").alias("_mean"),
        *[holds(F.floor(k)).alias(f"_low_{name}") for name, k in exact.items()],
        *[holds(F.least(F.floor(k) + 1, F.col("_total") - 1)).alias(f"_high_{name}") for name, k in exact.items()],
    )
    return found.select(
        *by,
        F.col("_total").alias("measurements"),
        *[
            round_half_even(F.col(f"_low_{n}") + (k - F.floor(k)) * (F.col(f"_high_{n}") - F.col(f"_low_{n}")), 2).alias(n)
            for n, k in exact.items()
        ],
        round_half_even(F.col("_mean"), 2).alias("mean_ms"),
    )
