"""Records that other tools landed: key-value pairs, REST answers, messages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.files import json_items


def glob_pattern(glob: str) -> str:
    """A key glob (``*``, ``?``, ``[...]``, ``[^...]``, backslash escapes) as a regular expression."""
    parts = re.findall(r"\\.|\[[^\]]+\]|[*?]|.", glob, flags=re.DOTALL)
    wild = {"*": "(?s:.*)", "?": "(?s:.)"}
    return "^" + "".join(
        wild.get(p) or (p if p.startswith("[") and len(p) > 1 else re.escape(p[-1])) for p in parts
    ) + "$"


def key_value_documents(pairs: DataFrame, *, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """Pairs (key, type, value) whose key matches, as JSON documents. Plain strings are quoted, the
    other types already hold JSON."""
    kept = pairs if pattern == "*" else pairs.where(F.rlike("key", F.lit(glob_pattern(pattern))))
    if limit is not None:
        kept = kept.orderBy("key").limit(limit)
    plain = F.to_json(F.struct("key", "value"), {"ignoreNullFields": "false"})
    head = F.to_json(F.struct("key"))
    nested = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"value":'), F.coalesce("value", F.lit("null")), F.lit("}"))
    return kept.withColumn("_head", head).select(
        F.when(F.col("type") == "string", plain).otherwise(nested).alias("content"),
        F.create_map(F.lit("key"), F.col("key"), F.lit("pattern"), F.lit(pattern)).alias("metadata"),
        F.lit(f"redis://{pattern}").alias("source_ref"),
    )


def rest_documents(answers: DataFrame, *, endpoint: str, content: str = "body", limit: int | None = None) -> DataFrame:
    """Landed answers of an endpoint, one document per item; a single object is a list of one."""
    items = json_items(answers.select(content), content)
    if limit is not None:
        items = items.limit(limit)
    return items.select(
        "content",
        F.create_map(F.lit("endpoint"), F.lit(endpoint)).alias("metadata"),
        F.lit(f"rest_api://{endpoint}").alias("source_ref"),
    )


def message_documents(messages: DataFrame) -> DataFrame:
    """Messages (topic, partition, offset, value) as documents; those without a value are skipped.
    Works alike on batches and on streams."""
    place = [F.create_map(*[x for name in ("topic", "partition", "offset") for x in (F.lit(name), F.col(name).cast("string"))])]
    return messages.where(F.col("value").isNotNull()).select(
        F.col("value").cast("string").alias("content"),
        place[0].alias("metadata"),
        F.concat(F.lit("kafka://"), F.col("topic")).alias("source_ref"),
        *[c for c in ("timestamp",) if c in messages.columns],
    )


def read_topic(spark: SparkSession, topic: str, servers: str, *, limit: int | None = None, **options: str) -> DataFrame:
    """The messages of a topic, or the first ``limit`` of them by time and place. The Kafka package comes with the session."""
    messages = (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    if limit is not None:
        messages = messages.orderBy("timestamp", "partition", "offset").limit(limit)
    return message_documents(messages)


def stream_topic(spark: SparkSession, topic: str, servers: str, **options: str) -> DataFrame:
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return message_documents(messages)
