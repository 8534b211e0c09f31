"""Connected components of an edge table, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, in_parts

#: Edges that one task takes. Fewer edges than shuffle partitions times this go to fewer tasks.
EDGES_PER_TASK = 50_000


def _star(edges: DataFrame, few: bool) -> DataFrame:
    """For edges (u, v), seen from u: each v with the smallest of u and its neighbours. A few edges are in one task already, where a window needs no exchange; hubs of more are minimised, never gathered."""
    if few:
        return edges.select("u", "v", F.least(F.min("v").over(Window.partitionBy("u")), "u").alias("m"))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u").select("u", "v", "m")


def _ends(edges: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two edges (u, v) of each row, named by their columns."""
    return edges.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (first, second)])))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest id reachable) for every node that has an edge. ``edges``: long columns a and b.

    Each round rewires edges to smaller ends and is written to the shared folder, in as many tasks as the edges ask for; the number of
    rounds is about the logarithm of the longest chain. Equal, reversed and looping edges are allowed; an empty table gives an empty result.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = cut_lineage(current)
    size = current.count()
    before = None
    while True:
        current = in_parts(current, size, EDGES_PER_TASK)
        few = size <= EDGES_PER_TASK
        large = _star(_ends(current, ("u", "v"), ("v", "u")), few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        rewired = _ends(_star(large, few), ("v", "m"), ("u", "m"))
        current = cut_lineage(rewired.where("u <> v").distinct())
        now = tuple(current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == before:
            break
        before, size = now, now[0]
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
