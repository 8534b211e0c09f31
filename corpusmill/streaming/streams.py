"""Streams of documents: read in batches, clean, split, drop repeats, score by window.

Row-local steps are the batch functions themselves. State is bounded by the watermark. Every sink
takes a checkpoint folder, from which a stopped or broken query goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.chunk import chunk_documents
from corpusmill.operators.clean import CleanOptions, rejected_by, with_cleaned
from corpusmill.operators.entities import extract_entities
from corpusmill.operators.quality import noise

SKETCH_BITS = 14
DEDUP_SALTS = 16


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files that arrive below ``path``, a folder or a glob, as a stream, ``files_per_batch`` at a time."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def clean_stream(
    stream: DataFrame, options: CleanOptions = CleanOptions(collapse_newlines=False), *, content: str = "content"
) -> DataFrame:
    """Cleaning without duplicate removal. Blank lines stay by default, as chunking needs them."""
    cleaned = with_cleaned(stream, options, content=content)
    return cleaned.where(rejected_by(F.col(content), options).isNull())


def chunk_stream(stream: DataFrame, *, max_chunk_size: int = 1000, content: str = "content") -> DataFrame:
    return chunk_documents(stream, max_chunk_size=max_chunk_size, content=content)


def entity_stream(stream: DataFrame, *, content: str = "content") -> DataFrame:
    return extract_entities(stream, content=content)


def drop_repeats(
    stream: DataFrame, *, time: str, horizon: str, spread_by: str, content: str = "content", salts: int = DEDUP_SALTS
) -> DataFrame:
    """One document per text within the ``horizon``; a copy that comes later than that passes.

    A first pass per (text, salt) leaves at most ``salts`` copies of a text, so the second pass,
    which brings all copies together, meets no hot text. ``spread_by`` sets the salt.
    """
    marked = (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, horizon)
        .withColumn("_digest", F.md5(content))
        .withColumn("_salt", F.expr(f"pmod(xxhash64({spread_by}), {salts})"))
    )
    fewer = marked.dropDuplicatesWithinWatermark(["_digest", "_salt"])
    return fewer.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest", "_salt")


def quality_by_window(
    stream: DataFrame, *, time: str, late: str, width: str, by: Sequence[str] = (), content: str = "content"
) -> DataFrame:
    """Quality per tumbling window. Streams allow no exact distinct count, so unique texts are an estimate."""
    text = F.col(content)
    totals = (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width), *by)
        .agg(
            F.count(F.lit(1)).alias("total_chunks"),
            F.approx_count_distinct(F.md5(text)).alias("unique_chunks"),
            F.avg(noise(text).cast("int")).alias("noise_ratio"),
            F.least(F.avg(F.length(text)) / 500.0, F.lit(1.0)).alias("coverage"),
        )
    )
    duplicates = F.greatest(1.0 - F.col("unique_chunks") / F.col("total_chunks"), F.lit(0.0))
    overall = (1.0 - duplicates) * 0.4 + (1.0 - F.col("noise_ratio")) * 0.3 + F.col("coverage") * 0.3
    return totals.select(
        F.col("window.start").alias("window_start"),
        *by,
        "total_chunks",
        "unique_chunks",
        duplicates.alias("duplicate_ratio"),
        "noise_ratio",
        "coverage",
        overall.alias("overall"),
    )


def quality_parts(batch: DataFrame, *, time: str, width: str, by: Sequence[str] = (), content: str = "content") -> tuple[DataFrame, DataFrame]:
    """What one batch adds to the quality of its windows, in a form that later batches are merged with.

    Sums and a sketch of the texts (HyperLogLog) per window, and the different texts of each window as digests. The first table is small whatever
    the texts; the second gives the exact count.
    """
    text = F.col(content)
    slim = batch.select(
        F.window(F.col(time).cast("timestamp"), width)["start"].alias("window_start"), *by, F.md5(text).alias("digest"), noise(text).cast("long").alias("noisy"), F.length(text).alias("chars")
    )
    sums = slim.groupBy("window_start", *by).agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum("noisy").alias("noisy"), F.sum("chars").alias("chars"), F.hll_sketch_agg("digest", F.lit(SKETCH_BITS)).alias("sketch")
    )
    return sums, slim.select("window_start", *by, "digest").distinct()


def merged_quality(sums: DataFrame, digests: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Quality per window from the parts of all batches, late ones included. ``estimated_chunks`` comes from the sketches alone, with a
    standard error of 0.8 percent (1.04 over the root of 2 ** SKETCH_BITS, rounded up)."""
    keys = ["window_start", *by]
    total = sums.groupBy(*keys).agg(
        F.sum("total_chunks").alias("total_chunks"), F.sum("noisy").alias("noisy"), F.sum("chars").alias("chars"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_chunks")
    )
    unique = digests.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_chunks"))
    unique = unique.select(*[F.col(c).alias(f"_{c}") for c in keys], "unique_chunks")
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    rows = total.join(unique, match)
    rows = rows.withColumns(
        {
            "duplicate_ratio": 1.0 - F.col("unique_chunks") / F.col("total_chunks"),
            "noise_ratio": F.col("noisy") / F.col("total_chunks"),
            "coverage": F.least(F.coalesce(F.col("chars"), F.lit(0)) / F.col("total_chunks") / 500.0, F.lit(1.0)),
        }
    )
    overall = (1.0 - F.col("duplicate_ratio")) * 0.4 + (1.0 - F.col("noise_ratio")) * 0.3 + F.col("coverage") * 0.3
    return rows.select(*keys, "total_chunks", "unique_chunks", "estimated_chunks", "duplicate_ratio", "noise_ratio", "coverage", overall.alias("overall"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, *, drain: bool = True) -> StreamingQuery:
    """Append the stream to parquet files. ``drain`` handles what is there and stops; otherwise the
    query runs until its ``stop()``."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if drain else writer).start(path)
    if drain:
        query.awaitTermination()
    return query


def process_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    mode: str = "append",
    drain: bool = True,
) -> StreamingQuery:
    """Hand every micro-batch, the last short one included, to ``handle(batch, batch_id)``. After a
    failure a batch may come again under the same id."""
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if drain else writer).start()
    if drain:
        query.awaitTermination()
    return query


def numbered_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle
