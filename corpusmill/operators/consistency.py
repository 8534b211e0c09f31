"""Agreement among several responses to one prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.numbers import round_half_even
from corpusmill.functions.text import jaccard, normalized, tokens
from corpusmill.session import cut_lineage

PROMPT = ("model_id", "prompt_id")
BLOCK = 64
SPARSE = 0.05  # a meeting in a list costs about as much as twenty comparisons in a block
FLAGGED_BELOW = 0.7


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def exact_consistency(responses: DataFrame, *, by: Sequence[str] = PROMPT, response: str = "response") -> DataFrame:
    """Per prompt, the share of response pairs that are the same answer. Equal answers are counted,
    never paired."""
    counts = responses.groupBy(*by, normalized(F.col(response)).alias("_answer")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("responses"), F.sum(_pairs(F.col("_n"))).alias("_same"))
    score = F.when(F.col("responses") < 2, 1.0).otherwise(F.try_divide(F.col("_same"), _pairs(F.col("responses"))))
    return totals.select(*by, "responses", score.alias("consistency"))


def _block_sum(members: Column, low: Column, high: Column) -> Column:
    """Weighted overlap summed over the pairs of one block pair."""

    def against(one: Column, others: Column) -> Column:
        return F.aggregate(
            others,
            F.lit(0.0),
            lambda total, other: total + one["weight"] * other["weight"] * jaccard(one["words"], other["words"]),
        )

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, b: a + b)

    left = F.filter(members, lambda m: m["block"] == low)
    right = F.filter(members, lambda m: m["block"] == high)
    inside = total(F.transform(left, lambda one, i: against(one, F.slice(left, i + 2, F.size(left)))))
    across = total(F.transform(left, lambda one: against(one, right)))
    return F.when(low == high, inside).otherwise(across)


def _with_blocks(merged: DataFrame, by: Sequence[str], large: DataFrame, block: int) -> DataFrame:
    """Overlap per prompt, summed over all pairs of word sets, block pair by block pair."""
    sized = large.select(*by, F.ceil(F.col("_sets") / block).alias("_blocks"))
    placed = (
        merged.join(sized, list(by), "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)).cast("int"))
        .withColumn("_block", F.expr("pmod(xxhash64(_words), _blocks)").cast("int"))
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    copies = (
        placed.withColumn("_partner", partner)
        .withColumn("_low", F.least("_block", "_partner"))
        .withColumn("_high", F.greatest("_block", "_partner"))
    )
    member = F.struct(F.col("_block").alias("block"), F.col("_words").alias("words"), F.col("_weight").alias("weight"))
    return (
        copies.groupBy(*by, "_low", "_high")
        .agg(F.collect_list(member).alias("_members"))
        .select(*by, _block_sum(F.col("_members"), F.col("_low"), F.col("_high")).alias("_overlap"))
        .groupBy(*by)
        .agg(F.sum("_overlap").alias("_overlap"))
    )


def _with_postings(postings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlap per prompt from (prompt, word) lists: only sets that share a word meet, and each meeting counts one shared word."""
    left = postings.select(*by, "_word", *[F.col(c).alias(f"{c}1") for c in ("_id", "_n", "_weight")])
    right = postings.select(*by, "_word", *[F.col(c).alias(f"{c}2") for c in ("_id", "_n", "_weight")])
    pairs = left.join(right, [*by, "_word"]).where("_id1 < _id2")
    shared = pairs.groupBy(*by, "_id1", "_id2", "_n1", "_n2", "_weight1", "_weight2").agg(F.count(F.lit(1)).alias("_c"))
    overlap = F.col("_weight1") * F.col("_weight2") * (F.col("_c") / (F.col("_n1") + F.col("_n2") - F.col("_c")))
    return shared.groupBy(*by).agg(F.sum(overlap).alias("_overlap"))


def self_consistency(
    responses: DataFrame, *, by: Sequence[str] = PROMPT, response: str = "response", block: int = BLOCK, sparse: float = SPARSE
) -> DataFrame:
    """Per prompt, the mean word overlap over all pairs of responses (1 for a lone response).

    Responses with the same words are merged first and weighted. A prompt with more than ``block`` sets is summed in one of two ways, by
    counts of its words. Where sets mostly have no word in common (meetings under a word are at most ``sparse`` of all pairs), an inverted index of
    words brings together those that do. Otherwise the sets are cut into blocks of about ``block``, and each task sums the pairs of one block
    pair. No task meets a whole prompt. An empty set overlaps with no other set.
    """
    words = F.sort_array(F.array_distinct(tokens(F.col(response))))
    merged = responses.groupBy(*by, words.alias("_words")).agg(F.count(F.lit(1)).alias("_weight"))
    totals = merged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_sets"), F.sum("_weight").alias("responses"), F.sum(_pairs(F.col("_weight"))).alias("_same")
    )
    large = totals.where(F.col("_sets") > block).select(*by, "_sets")
    if large.isEmpty():
        sums = _with_blocks(merged, by, large, block)
    else:
        big = cut_lineage(merged.join(large, list(by)).withColumn("_id", F.monotonically_increasing_id()))
        postings = big.select(*by, "_id", F.size("_words").alias("_n"), "_weight", F.explode("_words").alias("_word"))
        meetings = postings.groupBy(*by, "_word").agg(F.count(F.lit(1)).alias("_df")).groupBy(*by).agg(F.sum(_pairs(F.col("_df"))).alias("_meetings"))
        thin = large.join(meetings, list(by)).where(F.col("_meetings") <= sparse * _pairs(F.col("_sets"))).select(*by)
        thin = cut_lineage(thin)
        met = _with_postings(postings.join(thin, list(by), "left_semi"), by)
        sums = thin.join(met, list(by), "left").select(*by, F.coalesce("_overlap", F.lit(0.0)).alias("_overlap"))
        sums = sums.unionByName(_with_blocks(merged.join(thin, list(by), "left_anti"), by, large, block))
    score = F.when(F.col("responses") < 2, 1.0).otherwise(
        F.try_divide(F.col("_overlap") + F.col("_same"), _pairs(F.col("responses")))
    )
    return totals.join(sums, list(by)).select(*by, "responses", score.alias("consistency"))


def divergent_prompts(scores: DataFrame, *, below: float = FLAGGED_BELOW) -> DataFrame:
    """Prompts whose responses drift apart; a lone response cannot."""
    flagged = scores.where((F.col("responses") >= 2) & (F.col("consistency") < below))
    return flagged.withColumn("consistency", round_half_even(F.col("consistency"), 4))


def mean_consistency(scores: DataFrame, *, by: Sequence[str] = ("model_id",)) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("consistency").alias("consistency"), F.count(F.lit(1)).alias("prompts"))
