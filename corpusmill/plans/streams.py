"""Streaming queries: the driver's tables arrive as files, and the drained result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.clean import CleanOptions
from corpusmill.plans.cleaning import _CLEANED, sql_quality
from corpusmill.plans.common import rounded, table
from corpusmill.plans.text import sql_chunks, sql_entities
from corpusmill.session import scratch_path
from corpusmill.sources import landed
from corpusmill.streaming import streams

# Documents arrive one per second from 2024 on. (A stream's watermark starts at the epoch, and rows
# at or before it count as late.)
ARRIVAL = 1_704_067_200


def _stream(spark, sf_dir, name):
    """A glob, so the table may be one file or a folder of files."""
    return streams.stream_files(spark, f"{sf_dir}/{name}.p*", table(spark, sf_dir, name).schema)


def _documents(spark, sf_dir):
    return _stream(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), "lang", F.timestamp_seconds(F.col("doc_id") + ARRIVAL).alias("ts")
    )


def _drained(spark, stream):
    path = scratch_path(spark, "stream")
    streams.write_stream(stream, f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows")


def stream_clean(spark, sf_dir):
    cleaned = streams.clean_stream(_documents(spark, sf_dir), CleanOptions())
    return _drained(spark, cleaned.select("doc_id", "content"))


def stream_chunks(spark, sf_dir):
    chunks = streams.chunk_stream(_documents(spark, sf_dir).select("doc_id", "content"))
    return _drained(spark, chunks)


def stream_entities(spark, sf_dir):
    found = streams.entity_stream(_documents(spark, sf_dir).select("doc_id", "content"))
    return _drained(spark, found)


def stream_messages(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("props").cast("binary").alias("value"),
    )
    docs = landed.message_documents(events)
    return _drained(spark, docs.select("content", "source_ref", F.col("metadata")["offset"].alias("offset")))


def stream_dedup(spark, sf_dir):
    """Horizon beyond the whole stream, so every text stays once."""
    kept = streams.drop_repeats(_documents(spark, sf_dir), time="ts", horizon="36500 days", spread_by="doc_id")
    return _drained(spark, kept.select(F.md5("content").alias("digest"), F.length("content").alias("chars")))


def stream_quality(spark, sf_dir):
    """Quality per hour of arrival and language, merged from what each batch adds."""
    path = scratch_path(spark, "stream")

    def handle(batch, batch_id):
        for part, rows in zip(("sums", "digests"), streams.quality_parts(batch, time="ts", width="1 hour", by=["lang"])):
            streams.numbered_writer(f"{path}/{part}")(rows, batch_id)

    streams.process_batches(_documents(spark, sf_dir), handle, f"{path}/state")
    scores = streams.merged_quality(*(spark.read.parquet(f"{path}/{part}") for part in ("sums", "digests")), by=["lang"])
    named = scores.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")).drop("estimated_chunks")
    return rounded(named, "duplicate_ratio", "noise_ratio", "coverage", "overall")


def stream_batches(spark, sf_dir):
    """Eight files, two per batch; no row of the last batch is lost."""
    path = scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events")
    events.repartition(8).write.parquet(f"{path}/in")
    stream = streams.stream_files(spark, f"{path}/in", events.schema, files_per_batch=2)
    streams.process_batches(stream, streams.numbered_writer(f"{path}/rows"), f"{path}/state")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


def stream_resume(spark, sf_dir):
    """Stopped after the first files, taken up again from the checkpoint: each event once."""
    path = scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events")
    for even in (True, False):
        events.where((F.col("user_id") % 2 == 0) == even).write.mode("append").parquet(f"{path}/in")
        stream = streams.stream_files(spark, f"{path}/in", events.schema)
        streams.write_stream(stream.select("event_id", "event_type", "value"), f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows")


QUERIES = {
    "stream_clean": stream_clean,
    "stream_chunks": stream_chunks,
    "stream_entities": stream_entities,
    "stream_messages": stream_messages,
    "stream_dedup": stream_dedup,
    "stream_quality": stream_quality,
    "stream_batches": stream_batches,
    "stream_resume": stream_resume,
}

_DOCS = "SELECT *, text AS content FROM documents"
_BY_HOUR = f"""
SELECT strftime(date_trunc('hour', make_timestamp((doc_id + {ARRIVAL}) * 1000000)), '%Y-%m-%d %H:%M') || '|' || lang AS k,
  text AS content FROM documents"""

ORACLE = {
    "stream_clean": f"SELECT doc_id, content FROM ({_CLEANED}) WHERE length(content) >= 10",
    "stream_chunks": sql_chunks(_DOCS, "doc_id", 1000),
    "stream_entities": sql_entities(_DOCS, "doc_id"),
    "stream_messages": """
SELECT props AS content, 'kafka://' || event_type AS source_ref, event_id::VARCHAR AS "offset" FROM events""",
    "stream_dedup": "SELECT DISTINCT md5(text) AS digest, length(text)::INT AS chars FROM documents",
    "stream_quality": f"""
SELECT split_part(k, '|', 1) AS window_start, split_part(k, '|', 2) AS lang,
  total_chunks, unique_chunks, duplicate_ratio, noise_ratio, coverage, overall
FROM ({sql_quality(_BY_HOUR, "k")})""",
    "stream_batches": """
SELECT event_type, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type""",
    "stream_resume": "SELECT event_id, event_type, value FROM events",
}
