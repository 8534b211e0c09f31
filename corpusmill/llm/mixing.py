"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree. All of it is DataFrame functions.

Every source is cut into blocks of documents by hash. Its blocks are drawn in a permuted order, whole rounds of all blocks first; the last block
drawn is cut inside, so a source gives its target to the word. The numbers of drawn blocks per source are the quotas at
the root of a tree over the output shards. A node deals its quotas to its two halves as if its blocks were shuffled and the first
half cut off: the sources, one after another, get hypergeometric numbers (inverted from exact weights by a hash of node and source).
So the quotas of every shard are whole numbers that add up, shards hold equally many blocks, and no block is moved to find out. A
shard then takes its own stretch of every source's draws; stretches are disjoint. Inside a shard, documents are ordered by hash.

Only ids and sizes are shuffled, texts are read once. Rows with the same doc_id, source and size are merged before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import bound
from corpusmill.session import cut_lineage

WEIGHTS = (5, 2, 1)
EPOCHS = 3  # the most often that a word is taken
BLOCKS = 4_096  # per source, at most
SHARDS = 16
SEED = 13
COPIES = 4_096  # copies of a merged row that one task writes out
WORD = r"[^\x20\x09-\x0D]++"
#: Tails beyond so many standard deviations weigh less than a double can tell.
TAIL = 10


def _hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` items are among ``drawn`` of ``total``, by inversion of ``u`` in [0, 1). Weights start at 1 and grow by ratios."""
    mean = drawn * (marked / total)
    spread = F.sqrt(mean * (1 - marked / total) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - TAIL * spread - TAIL).cast("long"))
    high = F.least(drawn, marked, F.ceil(mean + TAIL * spread + TAIL).cast("long"))

    def after(weight: Column, k: Column) -> Column:
        return weight * ((marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1)))

    def invert(ends: Column) -> Column:
        values = F.sequence(ends["low"], ends["high"])
        begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        everything = F.aggregate(values, begin, lambda t, k: F.struct(after(t["w"], k).alias("w"), (t["s"] + t["w"]).alias("s")), lambda t: t["s"])

        def found(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), ends["low"].alias("x"))
            return F.aggregate(
                values,
                start,
                lambda t, k: F.struct(
                    after(t["w"], k).alias("w"), (t["s"] + t["w"]).alias("s"), F.when(t["s"] + t["w"] <= goal, F.least(k + 1, ends["high"])).otherwise(t["x"]).alias("x")
                ),
                lambda t: t["x"],
            )

        return bound(u * everything, found)

    drawn_some = bound(F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")), invert)
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("long")).otherwise(drawn_some)


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Deals one row's ``quota`` (an array, one number per source) to ``shards``: rows of shard and quota, which add up to it."""
    nodes = quotas.select(F.lit(0).alias("shard"), F.lit(shards).alias("m"), "quota")
    total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, b: a + b)
    for level in range((shards - 1).bit_length()):

        def left(node: DataFrame, level: int = level) -> Column:
            all_ = F.col("_all")
            start = F.struct(
                F.lit(0).alias("i"), all_.alias("rest"), F.floor(all_ * F.floor(F.col("m") / 2) / F.col("m")).cast("long").alias("need"), F.array().cast("array<bigint>").alias("out")
            )

            def deal(state: Column, quota: Column) -> Column:
                u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), state["i"])
                drawn = _hypergeometric(quota, F.greatest(state["rest"], F.lit(1).cast("long")), state["need"], u)
                return bound(
                    drawn,
                    lambda x: F.struct(
                        (state["i"] + 1).alias("i"), (state["rest"] - quota).alias("rest"), (state["need"] - x).alias("need"), F.array_append(state["out"], x).alias("out")
                    ),
                )

            return F.aggregate("quota", start, deal, lambda state: state["out"])

        half = F.floor(F.col("m") / 2).cast("int")
        nodes = nodes.withColumn("_all", total).withColumn("_left", F.explode(F.array(left(nodes))))
        right = F.zip_with("quota", "_left", lambda a, b: a - b)
        children = F.array(
            F.struct(F.col("shard"), half.alias("m"), F.col("_left").alias("quota")), F.struct((F.col("shard") + half).alias("shard"), (F.col("m") - half).alias("m"), right.alias("quota"))
        )
        nodes = nodes.select(F.explode(children).alias("child")).select("child.*").where("m > 0")
    return nodes.select("shard", "quota")


def _with_targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to rows of (source, source_size). Targets share all words by weight; each stops at ``EPOCHS`` times its
    source's size, and the excess goes to the others by weight. In rising order of cap over weight, the capped sources come first.
    There is a row per source, and they are numbered in one task."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("k") - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sources.withColumn("k", place).withColumn("weight", weight.cast("long")).withColumn("_cap", EPOCHS * F.col("source_size"))
    everywhere = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_words": F.sum("source_size").over(everywhere),
            "_weights": F.sum("weight").over(everywhere),
            "_words_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    share = wide("_cap") * (F.col("_weights") - F.col("_weights_before")).cast("decimal(18,0)")
    rows = rows.withColumn("_capped", share <= wide("weight") * (F.col("_words") - F.col("_words_before")).cast("decimal(18,0)"))
    capped = lambda c: F.sum(F.when(F.col("_capped"), F.col(c)).otherwise(0)).over(everywhere)
    rest = F.col("weight") * ((F.col("_words") - capped("_cap")) / (F.col("_weights") - F.nullif(capped("weight"), F.lit(-1))))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(rest)
    return rows.withColumn("target", target).select("k", "source", "source_size", "weight", "target")


def _written_out(rows: DataFrame) -> DataFrame:
    """A row per copy of the merged rows, numbered in ``copy``. Many copies of one row are dealt out first."""
    few = rows.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = rows.where(F.col("copies") > COPIES).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("doc_id", "_from").withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("copies")) - 1)))
    return few.unionByName(many.drop("_from"))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, size (words), source, source_size, target (of its source, in words), taken, and draws.

    ``draws``: the parts that the mix takes, each with epoch, shard and words (less than size only in the last block of a source). The words taken
    from a source equal its target, rounded; a document is taken ``EPOCHS`` times at most. The result depends on values alone, so reruns
    agree. Null texts have no words and are drawn without any. Null sources are a source, which comes last. Null and
    repeated doc_ids are rows like others, and equal rows are told apart by a running number. Texts of any length are counted
    whole. Only the three named columns are read. An empty table, or one without words, takes nothing.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = cut_lineage(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    sources = cut_lineage(_with_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))))

    named = sources.select("k", F.col("source").alias("_source"), "source_size", "target")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("_hash", F.lit("block")), F.lit(blocks)))
    inside = Window.partitionBy("k", "block").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("k", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))

    # Blocks in permuted order, and what each gives in the round that is not whole.
    order = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "k", "block"), "block")
    held = held.withColumns(
        {"nth": (F.row_number().over(order) - 1).cast("long"), "_before": F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    held = held.withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("k")))
    quota = F.round("target").cast("long")
    rounds = sources.where("source_size > 0").select(F.col("k").alias("_k"), F.expr("CAST(round(target) AS BIGINT) DIV source_size").alias("whole"), (quota % F.col("source_size")).alias("rest"))
    held = held.join(rounds, F.col("k") == F.col("_k")).drop("_k")
    held = held.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("_before"))))
    held = held.withColumn("_part_nth", F.coalesce(F.count(F.when(F.col("part") > 0, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = held.withColumn("epochs", F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).where("epochs > 0")
    held = cut_lineage(held.select("k", "block", "nth", "_part_nth", "n_blocks", "whole", "part", "epochs"))

    quotas = held.groupBy("k").agg(F.sum("epochs").alias("quota")).agg(F.sort_array(F.collect_list(F.struct("k", "quota"))).alias("_q"))
    dealt = splitting_tree(quotas.select("_q", F.col("_q.quota").alias("quota")), shards, seed).select("shard", F.posexplode("quota").alias("i", "quota"))
    ends = F.sum("quota").over(Window.partitionBy("i").orderBy("shard"))
    ends = dealt.withColumn("end", ends).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda e: e["end"]).alias("ends"))
    numbered = held.select("k").distinct().withColumn("i", F.row_number().over(Window.orderBy("k")) - 1).join(ends, "i").select(F.col("k").alias("_k"), "ends")
    drawn = held.join(numbered, F.col("k") == F.col("_k")).withColumn("_epoch", F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))

    def draw(epoch: Column) -> Column:
        number = epoch * F.col("n_blocks") + F.when(epoch == F.col("whole"), F.col("_part_nth")).otherwise(F.col("nth"))
        return F.struct(
            epoch.cast("int").alias("epoch"), F.size(F.filter("ends", lambda e: e <= number)).alias("shard"), F.when(epoch == F.col("whole"), F.col("part")).alias("limit")
        )

    plan = drawn.select(F.col("k"), F.col("block"), F.transform("_epoch", draw).alias("_draws"))

    rows = placed.withColumn("_start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).join(plan, ["k", "block"], "left")
    rows = _written_out(rows)
    # A whole draw has no limit; in the last one, the block's words up to the limit are taken.
    left = lambda d: F.coalesce(d["limit"], F.lit(1 << 62)) - F.col("_start") - F.col("copy") * F.col("size")
    words = lambda d: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left(d)))
    draws = F.transform(F.coalesce("_draws", F.array()), lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).alias("words")))
    rows = rows.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda t, d: t + d["words"])
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "draws", "copy")


def shuffled_shards(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The parts of the mix, shard by shard and shuffled inside: shard, place (ascending order in the shard), doc_id, copy, epoch, words."""
    parts = mixed.select("doc_id", "copy", "size", F.explode("draws").alias("draw")).select("doc_id", "copy", "size", "draw.*")
    parts = parts.where((F.col("words") > 0) | (F.col("size") == 0))
    parts = parts.withColumn("place", F.xxhash64(F.lit(seed), "shard", "doc_id", "copy", "epoch", "size"))
    parts = parts.select("shard", "place", "doc_id", "copy", "epoch", "words")
    return parts.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id", "copy", "epoch")
