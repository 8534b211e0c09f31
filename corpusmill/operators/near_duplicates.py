"""Near-duplicates: a document goes when it is nearly equal to an earlier one that stays.

Nearly equal means a Jaccard similarity of the word-shingle sets of at least ``threshold``. Candidates
are complete, not sampled. Two sets that similar differ in at most d shingles, where d follows from
their size. Cut the shingles into d + 1 parts by hash, and at least one part is the same in both. So
documents meet under equal parts only; a part of a threshold of 0.95 spans about 19 shingles, so
unrelated documents hardly meet. Every meeting is then verified on the whole sets.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import tokens
from corpusmill.session import cut_lineage

THRESHOLD = 0.95
SHINGLE_WORDS = 3
LARGEST_SET = 10**9
ROUND_SHARE = 0.1


def shingles(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Sorted hashes of the distinct word runs. A text shorter than a run counts as one run."""

    def runs(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found) - (words - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(found, i, words), " ")))

    # The one-element array binds the word list, so it is split once and not once per run.
    return F.array_sort(F.array_distinct(F.transform(F.array(tokens(text)), runs)[0]))


def similarity(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def size_classes(threshold: float) -> list[int]:
    """Lower bounds of set-size classes. Sets similar enough lie in the same class or in neighbours."""
    bounds = [1]
    while bounds[-1] <= LARGEST_SET:
        bounds.append(int(bounds[-1] / threshold) + 1)
    return bounds


def _part_keys(threshold: float):
    bounds = size_classes(threshold)
    spread = 2.0 * (1.0 - threshold) / (1.0 + threshold)
    mix = np.uint64(0x9E3779B97F4A7C15)

    def keys(values: np.ndarray) -> np.ndarray:
        """One key per part, for the document's own size class and the next."""
        hashes = np.asarray(values, dtype="int64").view("uint64")
        own = bisect_right(bounds, len(hashes)) - 1
        found = []
        for space in (own, own + 1):
            parts = int(spread * (bounds[space + 1] - 1) + 1e-9) + 1
            place = (hashes % np.uint64(parts)).astype("int64")
            order = np.argsort(place, kind="stable")
            held, first = np.unique(place[order], return_index=True)
            signs = np.zeros(parts, dtype="uint64")
            signs[held] = np.bitwise_xor.reduceat(hashes[order], first)
            with np.errstate(over="ignore"):
                label = (np.uint64(space) << np.uint64(32)) + np.arange(parts, dtype="uint64") + np.uint64(1)
                found.append((signs ^ (label * mix)) * mix)
        return np.concatenate(found).view("int64")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def part_keys(sets: pd.Series) -> pd.Series:
        return sets.map(keys)

    return part_keys


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (early, late) of rows (id, _set) whose sets are similar, by a prefix-filter join.

    Every set is ordered by how rare its shingles are. Two similar sets share one among their first n - ceil(threshold * n) + 1, so only these
    meet; the places at which they meet and the sizes must still allow enough shared ones. Each pair is verified once, on the whole sets.
    """
    each = sets.select("id", F.size("_set").alias("n"), F.explode("_set").alias("h"))
    rare = each.groupBy("h").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    heads = cut_lineage(each.join(rare.where("df > 1"), "h").withColumn("at", place).withColumn("unshared", F.col("n") - F.count("*").over(Window.partitionBy("id"))))
    # Shingles of one document only come first in every order; they fill the prefix before any shared one.
    heads = heads.withColumn("at", F.col("at") + F.col("unshared")).where(F.col("at") <= prefix).select("h", "id", "n", "at")
    left, right = heads.toDF("h", "early", "n1", "at1"), heads.toDF("h", "late", "n2", "at2")
    needed = F.ceil((F.col("n1") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-6)
    possible = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) + 1
    met = left.join(right, "h").where((F.col("early") < F.col("late")) & (F.least("n1", "n2") >= threshold * F.greatest("n1", "n2") - 1e-6))
    # The first shared shingle of a pair is the one that leaves most room behind it, so passing at any of them is enough.
    met = met.where(possible >= needed).select("early", "late").distinct()
    sides = [sets.select(F.col("id").alias(name), F.col("_set").alias(f"_{name}")) for name in ("early", "late")]
    compared = met.join(sides[0], "early").join(sides[1], "late")
    return compared.where(similarity(F.col("_early"), F.col("_late")) >= threshold).select("early", "late")


def _dropped(pairs: DataFrame) -> DataFrame:
    """Ids that go when a document goes if an earlier one that it is paired with stays.

    A row (v, u, turned) says that v goes if u stays (or, turned, if u goes); v stays when none of its rows holds. A document with a single
    row is the opposite of what that row names, so every row that names it can name that other one instead. All such rows are replaced in
    every round, so a chain of documents shortens by half; rows that contradict each other, and known ones, decide documents meanwhile.
    """
    rows = cut_lineage(pairs.select(F.col("late").alias("v"), F.col("early").alias("u"), F.lit(False).alias("turned")))
    heads = rows.select(F.col("u").alias("v")).distinct().join(rows.select("v").distinct(), "v", "left_anti")
    known = cut_lineage(heads.withColumn("stays", F.lit(True)))
    found = []
    while not rows.isEmpty():
        told = rows.join(known.select(F.col("v").alias("u"), "stays"), "u", "left")
        told = told.withColumn("holds", F.col("stays") != F.col("turned"))
        state = told.groupBy("v").agg(
            (F.coalesce(F.bool_or("holds"), F.lit(False)) | (F.count_distinct(F.when(F.col("holds").isNull(), F.struct("u", "turned"))) > F.count_distinct(F.when(F.col("holds").isNull(), F.col("u"))))).alias("goes"),
            F.count_distinct(F.when(F.col("holds").isNull(), F.struct("u", "turned"))).alias("open"),
        )
        decided = cut_lineage(state.where("goes OR open = 0").select("v", (~F.col("goes")).alias("stays")))
        found.append(decided.where("NOT stays").select(F.col("v").alias("id")))
        left = told.where("holds IS NULL").select("v", "u", "turned").distinct().join(decided.select("v"), "v", "left_anti")
        single = state.where("NOT goes AND open = 1").select("v")
        single = left.join(single, "v", "left_semi").select(F.col("v").alias("_v"), F.col("u").alias("_u"), F.col("turned").alias("_turned"))
        left = left.join(single, F.col("u") == F.col("_v"), "left")
        # u is the opposite of its row, and a decided u keeps its name until the next round knows it.
        renamed = left.select("v", F.coalesce("_u", "u").alias("u"), F.when(F.col("_v").isNull(), F.col("turned")).otherwise(F.col("_turned") == F.col("turned")).alias("turned"))
        rows = cut_lineage(renamed.distinct())
        known = cut_lineage(known.unionByName(decided))
    gone = pairs.select(F.col("late").alias("id")).limit(0)
    for part in found:
        gone = gone.unionByName(part)
    return gone


def first_of_near_duplicates(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    content: str = "content",
    threshold: float = THRESHOLD,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """The ids of the documents that stay.

    Equal sets are merged by a grouped minimum first, so copies never meet. In every round those
    documents are settled that come first under all of their keys: they stay, and what they meet is
    compared with them and dropped when similar. The smallest open id is always among them, so the
    rounds end. Only (first, other) pairs are formed, so a family of copies is settled in a round or two, whatever its size. Rounds go on
    while each settles at least ``ROUND_SHARE`` of the open documents. What is then left are lookalikes that mostly are not similar:
    their similar pairs are found once, by a prefix-filter join, and the dependencies among those pairs are settled by substitution.
    """
    sets = documents.select(F.col(id_column).alias("id"), shingles(F.col(content), shingle_words).alias("_set"))
    digest = F.md5(F.array_join(F.col("_set").cast("array<string>"), ","))
    merged = sets.groupBy(digest.alias("_digest")).agg(F.min_by(F.struct("id", "_set"), "id").alias("_row"))
    firsts = cut_lineage(merged.select("_row.*"))

    keys = firsts.select("id", F.explode(F.array_distinct(_part_keys(threshold)("_set"))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low < _high")
    members = cut_lineage(keys.join(shared.select("key"), "key", "left_semi"))
    held = cut_lineage(firsts.join(members.select("id").distinct(), "id", "left_semi"))
    staying = [firsts.select("id").join(members.select("id").distinct(), "id", "left_anti")]

    n_open = members.select("id").distinct().count()
    while n_open:
        leaders = members.groupBy("key").agg(F.min("id").alias("leader"))
        led = members.join(leaders, "key").where("leader < id")
        behind = cut_lineage(led.select("leader", "id").distinct())
        settled = members.select("id").distinct().join(behind.select("id").distinct(), "id", "left_anti")
        meetings = behind.join(settled.select(F.col("id").alias("leader")), "leader", "left_semi")
        leader_sets = held.select(F.col("id").alias("leader"), F.col("_set").alias("_leader_set"))
        compared = meetings.join(leader_sets, "leader").join(held, "id")
        dropped = compared.where(similarity(F.col("_set"), F.col("_leader_set")) >= threshold).select("id").distinct()
        decided = cut_lineage(
            settled.withColumn("stays", F.lit(True)).unionByName(dropped.withColumn("stays", F.lit(False)))
        )
        staying.append(decided.where("stays").select("id"))
        members = cut_lineage(members.join(decided.select("id"), "id", "left_anti"))
        before, n_open = n_open, members.select("id").distinct().count()
        if n_open > (1 - ROUND_SHARE) * before:
            rest = cut_lineage(held.join(members.select("id").distinct(), "id", "left_semi"))
            gone = _dropped(similar_pairs(rest, threshold))
            staying.append(rest.select("id").join(gone, "id", "left_anti"))
            break

    kept = staying[0]
    for part in staying[1:]:
        kept = kept.unionByName(part)
    return kept.withColumnRenamed("id", id_column)


def drop_near_duplicates(
    documents: DataFrame, *, id_column: str = "doc_id", content: str = "content", threshold: float = THRESHOLD
) -> DataFrame:
    kept = first_of_near_duplicates(documents, id_column=id_column, content=content, threshold=threshold)
    return documents.join(kept, id_column, "left_semi")
