"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group that stays together unless it exceeds a small share of a shard; then it is dealt into
``PARTS`` parts by hash of doc_id and the row's place in the input. Groups of less than a thousandth of a shard are bundled by hash of their text, so the
packer sees at most ``BUNDLES`` bundles and ``40 * 1024`` times a few large groups, whatever the size of the table. Items
go, largest first, to the shard where the dot product of the item and the shard's residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.quality import words
from corpusmill.llm.ranks import with_rank
from corpusmill.session import cut_lineage

ROW_BYTES = 16
BUNDLES = 1 << 16
PARTS = 64
#: A group above this share of a shard is split; one below the other share is bundled.
SPLIT_SHARE = 1 / 16
BUNDLE_SHARE = 1 / 1024
#: Weights of bytes, tokens and rows in the dot product: the law is on bytes.
WEIGHTS = (1.0, 0.1, 0.1)


def vector_pack(items: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item (a row of bytes, tokens and rows)."""
    out = np.zeros(len(items), dtype=np.int64)
    if not len(items):
        return out
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-9)
    scaled = items / capacity * np.sqrt(WEIGHTS)
    residual = np.tile(np.sqrt(WEIGHTS), (shards, 1))
    for k in np.argsort(-scaled[:, 0], kind="stable"):
        best = int(np.argmax(residual @ scaled[k]))
        out[k] = best
        residual[best] -= scaled[k]
    return out


def shard(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``) of every row.

    Only doc_id and text are read, so other columns may have any name. Null texts have size 16 and the checksum of no
    bytes. Rows without doc_id are placed like others; repeated rows are placed each, and both are dealt out by their place in
    the input where their text is hot. Very long texts are items of their own. Ties go by hash, then by bundle. An empty
    table gives no rows. A few numbers per row are kept in the shared folder; texts are read once and never shuffled.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(value) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.size(words(F.col(text))).cast("long").alias("tokens"),
        F.xxhash64(value).alias("_key"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = cut_lineage(rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "_at"), F.lit(PARTS)).cast("int")))
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = F.greatest(F.col("b") / float(total["b"]), F.col("t") / float(max(1, total["t"])), F.col("n") / float(total["n"])) * shards
    parts = rows.groupBy("_key", "text_crc32", "_part").agg(*sums)
    groups = parts.groupBy("_key", "text_crc32").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).withColumn("share", share)
    bundle = F.pmod(F.col("_key"), F.lit(BUNDLES)).cast("int")
    light = groups.where(F.col("share") < BUNDLE_SHARE).groupBy(bundle.alias("_bundle")).agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    heavy = groups.where(F.col("share") >= BUNDLE_SHARE)
    split = F.broadcast(heavy.where(F.col("share") > SPLIT_SHARE).select("_key", "text_crc32"))  # 3 * 16 * shards rows at most
    whole = heavy.where(F.col("share") <= SPLIT_SHARE).select("_key", "text_crc32", F.lit(-1).alias("_part"), "b", "t", "n")
    items = whole.unionByName(parts.join(split, ["_key", "text_crc32"], "left_semi"))
    light_rows = sorted(tuple(r) for r in light.collect())
    heavy_rows = sorted(tuple(r) for r in items.collect())
    vectors = np.array([r[1:] for r in light_rows] + [r[3:] for r in heavy_rows], dtype=np.float64).reshape(-1, 3)
    chosen = vector_pack(vectors, shards).tolist()
    spark = docs.sparkSession
    of_bundle = spark.createDataFrame([(r[0], s) for r, s in zip(light_rows, chosen)], "_bundle int, _light int")
    of_heavy = spark.createDataFrame(
        [(*r[:3], s) for r, s in zip(heavy_rows, chosen[len(light_rows) :])], "_key long, text_crc32 long, _p int, _heavy int"
    )
    heavy_whole = of_heavy.where("_p < 0").select("_key", "text_crc32", F.col("_heavy").alias("_whole"))
    heavy_part = of_heavy.where("_p >= 0").select("_key", "text_crc32", F.col("_p").alias("_part"), "_heavy")
    placed = (
        rows.withColumn("_bundle", bundle)
        .join(F.broadcast(of_bundle), "_bundle", "left")
        .join(F.broadcast(heavy_whole), ["_key", "text_crc32"], "left")
        .join(F.broadcast(heavy_part), ["_key", "text_crc32", "_part"], "left")
        .withColumn("shard", F.coalesce("_heavy", "_whole", "_light"))
    )
    ranked = with_rank(placed.select("doc_id", "size", "text_crc32", "shard", "_at"), "shard", ["doc_id", "text_crc32", "_at"], "slot", int(total["n"]))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
