"""Experiment runs: status, best run, summary, bits per byte."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.position import SEGMENT, with_minimum_before

CAMPAIGN = ("campaign_id",)


def label_runs(runs: DataFrame, *, by: Sequence[str] = CAMPAIGN, segment: int = SEGMENT) -> DataFrame:
    """Add ``status`` to runs (idx, final_loss, failed) in idx order.

    The first run is the baseline; a later one improved when it is strictly below all before it.
    When the first run failed there is no baseline to beat, so later runs count as regressed.
    """
    loss = F.when(~F.col("failed"), F.col("final_loss"))
    first = F.struct(F.col("idx"), F.col("failed"))
    seen = with_minimum_before(
        runs, {"_best": loss, "_first": first}, order_by="idx", within=by, segment=segment
    )
    status = (
        F.when(F.col("failed"), "failed")
        .when(F.col("_first").isNull(), "baseline")
        .when(F.col("_first.failed"), "regressed")
        .when(F.col("final_loss") < F.col("_best"), "improved")
        .otherwise("regressed")
    )
    return seen.withColumn("status", status).withColumn("val_bpb", loss).drop("_best", "_first")


def best_runs(runs: DataFrame, *, by: Sequence[str] = CAMPAIGN) -> DataFrame:
    """The run with the least val_bpb per campaign, the earliest among equals; blanks do not count."""
    row = F.struct(*[F.col(c) for c in runs.columns])
    return (
        runs.where(F.col("val_bpb").isNotNull())
        .groupBy(*by)
        .agg(F.min_by(row, F.struct("val_bpb", "idx")).alias("_row"))
        .select("_row.*")
    )


def summarize_runs(runs: DataFrame, *, by: Sequence[str] = CAMPAIGN) -> DataFrame:
    scored = F.when(F.col("val_bpb").isNotNull(), F.struct("val_bpb", "idx"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.count_if(F.col("status") == "improved").alias("improvements"),
        F.count_if(F.col("status") == "regressed").alias("regressions"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.min("val_bpb").alias("best_val_bpb"),
        F.min_by("experiment_id", scored).alias("best_experiment_id"),
    )


def bits_per_byte(losses: DataFrame, *, by: Sequence[str], loss: str = "loss_nats", size: str = "n_bytes") -> DataFrame:
    """Summed token losses per byte in bits; infinite without bytes."""
    totals = losses.groupBy(*by).agg(F.sum(loss).alias("_nats"), F.sum(size).alias("total_bytes"))
    bits = F.try_divide(F.col("_nats"), F.lit(math.log(2)) * F.col("total_bytes"))
    return totals.select(
        *by, "total_bytes", F.when(F.col("total_bytes") == 0, F.lit(float("inf"))).otherwise(bits).alias("bpb")
    )
