"""Input positions without a single-task sort.

The order column is an integer, so it cuts into segments that every task can compute for itself.
Rows are counted per segment, the counts are summed up into offsets, and rows are numbered inside their segment only. A segment holds
at most ``segment`` order values, however the rows are spread over groups.

The counts are summed up level by level: inside blocks of ``FAN`` segments, inside blocks of ``FAN`` such blocks, and over those. No window sees
more than ``FAN`` rows of a group, and with 64-bit numbers and the default segment the last level has 2 ** 17 rows at most. So ids may be
as dense as a counter or as thin as hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 8_192
FAN = 1 << 17


def segment_of(order_by: str, segment: int = SEGMENT) -> Column:
    return F.floor(F.col(order_by) / F.lit(segment)).cast("long")


def _from_earlier(leaves: DataFrame, values: Mapping[str, str], within: Sequence[str]) -> DataFrame:
    """Rows of (_g_ group columns, _g_segment) with, per value, its ``sum`` or ``min`` over the earlier segments of the group (null where there
    is none) as ``_before_`` and over the whole group as ``_all_``."""
    added = {"sum": lambda parts: sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)), "min": lambda parts: F.least(*parts)}
    merge = {"sum": F.sum, "min": F.min}

    def level(table: DataFrame, key: str, parent: str | None, mark: str) -> DataFrame:
        group = [*within, parent] if parent else list(within)
        earlier = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({f"_{mark}_{name}": merge[kind](F.col(name)).over(earlier) for name, kind in values.items()})

    def folded(table: DataFrame, key: str) -> DataFrame:
        return table.groupBy(*within, key).agg(*[merge[kind](F.col(name)).alias(name) for name, kind in values.items()])

    def joined(table: DataFrame, above: DataFrame, key: str) -> DataFrame:
        keys = [*within, key]
        added_columns = [c for c in above.columns if c not in keys and c not in values]
        named = above.select(*[F.col(c).alias(f"_up_{c}") for c in keys], *added_columns)
        match = F.lit(True)
        for column in keys:
            match = match & F.col(column).eqNullSafe(F.col(f"_up_{column}"))
        return table.join(named, match).select(*table.columns, *added_columns)

    block = lambda column: F.floor(F.col(column) / FAN).cast("long")
    first = level(leaves.withColumn("_s2", block("_segment")), "_segment", "_s2", "b1")
    second = level(folded(first, "_s2").withColumn("_s3", block("_s2")), "_s2", "_s3", "b2")
    third = level(folded(second, "_s3"), "_s3", None, "b3")
    everything = Window.partitionBy(*within)
    third = third.withColumns({f"_all_{name}": merge[kind](F.col(name)).over(everything) for name, kind in values.items()})
    rows = joined(joined(first, second, "_s2"), third, "_s3")
    return rows.select(
        *[F.col(c).alias(f"_g_{c}") for c in within],
        F.col("_segment").alias("_g_segment"),
        *[added[kind]([F.col(f"_b{k}_{name}") for k in (1, 2, 3)]).alias(f"_before_{name}") for name, kind in values.items()],
        *[F.col(f"_all_{name}") for name in values],
    )


def _with_offsets(rows: DataFrame, offsets: DataFrame, within: Sequence[str]) -> DataFrame:
    match = F.col("_segment").eqNullSafe(F.col("_g_segment"))
    for column in within:
        match = match & F.col(column).eqNullSafe(F.col(f"_g_{column}"))
    return rows.join(offsets, match)


def with_position(
    df: DataFrame,
    *,
    order_by: str,
    ties: Sequence[str] = (),
    within: Sequence[str] = (),
    segment: int = SEGMENT,
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Add the zero-based position of each row in the order (order_by, *ties), per ``within`` group.

    ``total`` names a further column for the number of rows in the group.
    """
    rows = df.withColumn("_segment", segment_of(order_by, segment))
    counts = rows.groupBy(*within, "_segment").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _from_earlier(counts, {"_rows": "sum"}, within)
    inside = Window.partitionBy(*within, "_segment").orderBy(order_by, *ties)
    place = (F.col("_before__rows") + F.row_number().over(inside) - 1).cast("long")
    numbered = _with_offsets(rows, offsets, within).withColumn(name, place)
    extra = [F.col("_all__rows").alias(total)] if total else []
    return numbered.select(*df.columns, name, *extra)


def with_minimum_before(
    df: DataFrame,
    values: Mapping[str, Column],
    *,
    order_by: str,
    within: Sequence[str] = (),
    segment: int = SEGMENT,
) -> DataFrame:
    """Add, for each name in ``values``, the least value among earlier rows of the group (null where
    there is none). Minima per segment run over the levels, rows only over their segment."""
    held = {name: f"_value_{name}" for name in values}
    rows = df.withColumns({held[name]: value for name, value in values.items()})
    rows = rows.withColumn("_segment", segment_of(order_by, segment))
    lows = rows.groupBy(*within, "_segment").agg(*[F.min(column).alias(column) for column in held.values()])
    offsets = _from_earlier(lows, dict.fromkeys(held.values(), "min"), within)
    inside = Window.partitionBy(*within, "_segment").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    joined = _with_offsets(rows, offsets, within).withColumns(
        {name: F.least(F.col(f"_before_{column}"), F.min(column).over(inside)) for name, column in held.items()}
    )
    return joined.select(*df.columns, *values)
