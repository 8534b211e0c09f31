"""Gapless ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers at a time, about.
ROWS_PER_BUCKET = 50_000


def with_rank(df: DataFrame, group: str, order: list[str], name: str, rows: int) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each ``group``. ``rows`` is the size of ``df`` and sets the number of hash buckets.

    Rows of a group are dealt into buckets by hash of ``order``, numbered inside a bucket, and moved up by the sizes of the
    buckets before it, so a group that holds all rows is still numbered by many tasks. Equal inputs get equal ranks but
    for rows that agree in all of ``order``, whose ranks may be swapped.
    """
    buckets = max(8, -(-rows // ROWS_PER_BUCKET))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")
    bases = sizes.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), before.alias("_base"))
    inner = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1
    joined = dealt.withColumn("_i", inner).join(bases, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(name, F.col("_base") + F.col("_i")).drop("_b", "_n", "_g", "_c", "_base", "_i")
