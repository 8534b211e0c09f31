"""Sources: tables, files, records and messages as documents."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import sinks
from corpusmill.operators import catalog
from corpusmill.plans.common import table
from corpusmill.session import scratch_path
from corpusmill.sources import fetch, files, landed
from corpusmill.sources.fetch import FetchQuery


def fetch_filtered(spark, sf_dir):
    query = FetchQuery("orders", columns=["o_orderkey", "o_totalprice"], filters={"o_orderstatus": "F", "o_orderpriority": "5-LOW"})
    return fetch.select_rows(table(spark, sf_dir, "orders"), query)


def fetch_page(spark, sf_dir):
    query = FetchQuery("orders", columns=["o_orderkey"], limit=25, offset=50, order_by=["o_totalprice", "o_orderkey"])
    return fetch.select_rows(table(spark, sf_dir, "orders"), query)


def row_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") > 100, F.col("o_custkey")))
    rows = rows.withColumn("large", F.col("o_totalprice") > 200000).drop("o_totalprice")
    docs = fetch.row_documents(rows, store="postgresql", table="orders")
    return docs.select("content", "source_ref", F.col("metadata")["columns"].alias("columns"))


def record_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") > 5, F.col("p_size"))).drop("p_retailprice")
    return fetch.record_documents(rows, store="mongodb", collection="part").select("content", "source_ref")


def search_documents(spark, sf_dir):
    rows = fetch.match_text(table(spark, sf_dir, "part"), {"p_name": "Red bolt", "p_type": "economy"})
    return fetch.record_documents(rows.select("p_partkey", "p_name"), store="elasticsearch", collection="part", key="index").select("content")


def incremental_fetch(spark, sf_dir):
    fresh = fetch.fetch_since(table(spark, sf_dir, "orders"), key="o_orderdate", checkpoint="1998-01-01 00:00:00")
    return fresh.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def incremental_checkpoint(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = fetch.next_checkpoint(events, key="event_id", checkpoint=500).withColumn("run", F.lit("new rows"))
    idle = fetch.next_checkpoint(events, key="event_id", checkpoint=10**12).withColumn("run", F.lit("no rows"))
    return first.unionByName(idle)


def _messages(spark, sf_dir):
    """Events in the layout of the Kafka source; errors come without a value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.when(F.col("event_type") != "error", F.col("props")).cast("binary").alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def kafka_documents(spark, sf_dir):
    docs = landed.message_documents(_messages(spark, sf_dir))
    return docs.select(
        "content", "source_ref", *[F.col("metadata")[k].alias(k) for k in ("topic", "partition", "offset")]
    )


def kafka_topics(spark, sf_dir):
    return catalog.topic_collections(_messages(spark, sf_dir))


def _pairs(spark, sf_dir):
    """Events as keys of a key-value store: strings for odd users, hashes for even ones."""
    even = F.col("user_id") % 2 == 0
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", "event_type", "user_id", "event_id").alias("key"),
        F.when(even, "hash").otherwise("string").alias("type"),
        F.when(even, F.col("props")).otherwise(F.concat(F.lit('say "'), F.col("event_type"), F.lit('"'))).alias("value"),
        "event_id",
    )


def key_value_documents(spark, sf_dir):
    docs = landed.key_value_documents(_pairs(spark, sf_dir), pattern="[cv]*:?:*")
    return docs.select("content", "source_ref", F.col("metadata")["key"].alias("key"))


def key_value_catalog(spark, sf_dir):
    return catalog.key_value_collections(_pairs(spark, sf_dir), order_by="event_id")


def rest_documents(spark, sf_dir):
    """Answers of three events each: a list of items, or a lone object where one is left over."""
    answers = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 3)).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("_items")
    )
    body = F.when(F.size("_items") == 1, F.to_json(F.col("_items")[0])).otherwise(F.to_json("_items"))
    return landed.rest_documents(answers.select(body.alias("body")), endpoint="events").select("content", "source_ref")


def json_catalog(spark, sf_dir):
    """Fields of the first document per event type."""
    record = F.to_json(
        F.struct(F.col("event_id").alias("_id"), "value", (F.col("value") > 5).alias("high"), F.col("event_type").alias("kind"), F.struct("user_id").alias("owner")),
    )
    docs = table(spark, sf_dir, "events").select("event_id", "event_type", record.alias("content"))
    fields = catalog.fields_from_json(docs, collection=F.col("event_type"), content=F.col("content"), order_by=["event_id"])
    return fields.select("collection", "field", "data_type", "is_primary_key", "row_count")


def csv_documents(spark, sf_dir):
    path = scratch_path(spark, "csv")
    _csv_source(spark, sf_dir).write.csv(path, header=True, escape='"')
    return files.csv_documents(spark, path).select("content", F.col("metadata")["format"].alias("format"))


def csv_lines(spark, sf_dir):
    path = scratch_path(spark, "csv")
    _csv_source(spark, sf_dir).write.csv(path, header=True, escape='"')
    return files.csv_lines(spark, path).select("content")


def csv_summary(spark, sf_dir):
    path = scratch_path(spark, "csv")
    _csv_source(spark, sf_dir).write.csv(path, header=True, escape='"')
    return files.csv_file_summary(spark, path).groupBy("headers").agg(F.sum("row_count").alias("row_count"))


def csv_two_headers(spark, sf_dir):
    """Files with different headers below one folder; each row goes under the names of its own file."""
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.csv(f"{path}/a", header=True)
    table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey").write.csv(f"{path}/b", header=True)
    return files.csv_documents(spark, path).select("content")


def csv_line_breaks(spark, sf_dir):
    """Documents and reviews of parts as CSV files with different headers, whose texts hold line breaks, commas and quotes."""
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.csv(f"{path}/a", header=True, escape='"', quoteAll=True, lineSep="\n")
    quoted = F.concat(F.lit('say "'), "p_name", F.lit('",\n'), "p_type", F.lit("\r\nend"))
    table(spark, sf_dir, "part").select(quoted.alias("note"), "p_partkey").write.csv(f"{path}/b", header=True, escape='"', quoteAll=True, lineSep="\n")
    rows, _ = files.csv_rows(spark, path)
    return rows.select(F.array_join("header", "|").alias("header"), F.array_join("values", "|").alias("row"))


def _csv_source(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('a "b", '), "s_name").alias("s_name"), "s_nationkey")


def json_documents(spark, sf_dir):
    path = scratch_path(spark, "json")
    rows = table(spark, sf_dir, "supplier")
    page = F.floor(F.col("s_suppkey") / 10).alias("page")
    lists = rows.groupBy(page).agg(F.to_json(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name")))).alias("value"))
    # One file per page of ten; page 0 lacks its closing bracket, so it stays text.
    cut = F.when(F.col("page") == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    texts = lists.select("page", cut.alias("value"))
    texts.repartition("page").write.partitionBy("page").option("lineSep", " ").format("text").save(path)
    found = files.json_items(spark.read.text(path, wholetext=True).select("value"))
    return found.select(F.trim("content").alias("content"), "format")


def object_kinds(spark, sf_dir):
    """Files of three kinds below one folder, listed by extension and read as documents."""
    path = scratch_path(spark, "objects")
    supplier = table(spark, sf_dir, "supplier")
    supplier.select("s_suppkey", "s_name").write.csv(f"{path}/a", header=True)
    supplier.select("s_suppkey").write.json(f"{path}/b")
    supplier.select("s_name").write.text(f"{path}/c")
    docs = files.object_documents(spark, path).groupBy(F.col("metadata")["format"].alias("kind")).agg(F.count(F.lit(1)).alias("documents"))
    kinds = catalog.file_collections(files.list_files(spark, path)).select(F.col("collection").alias("kind"), F.col("row_count").alias("files"))
    renamed = kinds.withColumn("kind", F.when(F.col("kind") == "txt", "text").otherwise(F.col("kind")))
    return docs.join(renamed, "kind", "full")


@F.pandas_udf(T.BinaryType())
def _as_docx(texts: pd.Series) -> pd.Series:
    """Minimal Word files with one paragraph per line."""
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def build(text: str) -> bytes:
        lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{main}"><w:body>{lines}</w:body></w:document>')
        return buffer.getvalue()

    return texts.map(build)


def docx_documents(spark, sf_dir):
    readable = F.regexp_replace("text", "[\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]", " ")
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _as_docx(readable).alias("content"))
    docs = files.docx_documents(source)
    return docs.select(
        F.col("source_ref").cast("long").alias("doc_id"), "content", F.col("metadata")["paragraph_count"].cast("int").alias("paragraphs")
    )


def report_json(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")), path)
    return spark.read.json(path).select("event_type", "n", "top")


def dataset_by_format(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sinks.write_dataset(docs, path, file_format="json", partition_by=["lang"])
    return spark.read.json(path).select("doc_id", "text", "lang")


QUERIES = {
    "fetch_filtered": fetch_filtered,
    "fetch_page": fetch_page,
    "row_documents": row_documents,
    "record_documents": record_documents,
    "search_documents": search_documents,
    "incremental_fetch": incremental_fetch,
    "incremental_checkpoint": incremental_checkpoint,
    "kafka_documents": kafka_documents,
    "kafka_topics": kafka_topics,
    "key_value_documents": key_value_documents,
    "key_value_catalog": key_value_catalog,
    "rest_documents": rest_documents,
    "json_catalog": json_catalog,
    "csv_documents": csv_documents,
    "csv_lines": csv_lines,
    "csv_summary": csv_summary,
    "csv_two_headers": csv_two_headers,
    "csv_line_breaks": csv_line_breaks,
    "json_documents": json_documents,
    "object_kinds": object_kinds,
    "docx_documents": docx_documents,
    "report_json": report_json,
    "dataset_by_format": dataset_by_format,
}

_KV = """
SELECT event_type || ':' || user_id || ':' || event_id AS key, user_id % 2 = 0 AS nested, props, event_type, event_id FROM events"""

ORACLE = {
    "csv_line_breaks": """
SELECT 'doc_id|text|lang' AS header, doc_id || '|' || text || '|' || lang AS "row" FROM documents UNION ALL
SELECT 'note|p_partkey', 'say "' || p_name || '",' || chr(10) || p_type || chr(13) || chr(10) || 'end|' || p_partkey FROM part""",
    "csv_two_headers": """
SELECT '{"s_suppkey":"' || s_suppkey || '","s_name":"' || s_name || '"}' AS content FROM supplier
UNION ALL SELECT '{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_custkey":"' || c_custkey || '"}' FROM customer""",
    "fetch_filtered": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
    "fetch_page": "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50",
    "row_documents": """
SELECT 'o_orderkey=' || o_orderkey || ', o_custkey=' || coalesce(CASE WHEN o_custkey > 100 THEN o_custkey END::VARCHAR, 'None')
  || ', o_orderstatus=' || o_orderstatus || ', o_orderdate=' || o_orderdate || ', o_orderpriority=' || o_orderpriority
  || ', large=' || CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END AS content,
  'postgresql://orders' AS source_ref, 'o_orderkey,o_custkey,o_orderstatus,o_orderdate,o_orderpriority,large' AS columns FROM orders""",
    "record_documents": """
SELECT to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand, 'p_type': p_type,
  'p_size': CASE WHEN p_size > 5 THEN p_size END})::VARCHAR AS content, 'mongodb://part' AS source_ref FROM part""",
    "search_documents": """
SELECT to_json({'p_partkey': p_partkey, 'p_name': p_name})::VARCHAR AS content FROM part
WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'bolt']) AND lower(p_type) = 'economy'""",
    "incremental_fetch": """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'""",
    "incremental_checkpoint": """
SELECT max(event_id) AS checkpoint, count(*) AS rows, 'new rows' AS run FROM events WHERE event_id > 500
UNION ALL SELECT 1000000000000, count(*), 'no rows' FROM events WHERE event_id > 1000000000000""",
    "kafka_documents": """
SELECT props AS content, 'kafka://' || event_type AS source_ref, event_type AS topic, (user_id % 4)::VARCHAR AS partition,
  event_id::VARCHAR AS "offset" FROM events WHERE event_type <> 'error'""",
    "kafka_topics": "SELECT event_type AS collection, 'topic' AS source_type, count(*) AS messages FROM events GROUP BY event_type",
    "key_value_documents": f"""
SELECT CASE WHEN nested THEN '{{"key":"' || key || '","value":' || props || '}}'
    ELSE to_json({{'key': key, 'value': 'say "' || event_type || '"'}})::VARCHAR END AS content,
  'redis://[cv]*:?:*' AS source_ref, key FROM ({_KV}) WHERE regexp_full_match(key, '[cv].*:.:.*')""",
    "key_value_catalog": """
SELECT event_type AS collection, 'collection' AS source_type, 'value' AS field,
  CASE WHEN arg_min(user_id, event_id) % 2 = 0 THEN 'json' ELSE 'string' END AS data_type, count(*) AS keys FROM events GROUP BY event_type""",
    "rest_documents": """
SELECT to_json({'event_id': event_id, 'event_type': event_type})::VARCHAR AS content, 'rest_api://events' AS source_ref FROM events""",
    "json_catalog": """
SELECT collection, field, data_type, field = '_id' AS is_primary_key, row_count FROM
  (SELECT event_type AS collection, count(*) AS row_count FROM events GROUP BY event_type),
  (VALUES ('_id', 'integer'), ('value', 'float'), ('high', 'boolean'), ('kind', 'string'), ('owner', 'json')) f(field, data_type)""",
    "csv_documents": """
SELECT to_json({'s_suppkey': s_suppkey::VARCHAR, 's_name': 'a "b", ' || s_name, 's_nationkey': s_nationkey::VARCHAR})::VARCHAR AS content,
  'csv' AS format FROM supplier""",
    "csv_lines": "SELECT s_suppkey || ',a \"b\", ' || s_name || ',' || s_nationkey AS content FROM supplier",
    "csv_summary": "SELECT 's_suppkey,s_name,s_nationkey' AS headers, count(*)::BIGINT AS row_count FROM supplier",
    "json_documents": """
SELECT to_json({'s_name': s_name, 's_suppkey': s_suppkey})::VARCHAR AS content, 'json' AS format FROM supplier WHERE s_suppkey >= 10
UNION ALL
SELECT '[' || string_agg(to_json({'s_suppkey': s_suppkey, 's_name': s_name})::VARCHAR, ',' ORDER BY s_suppkey), 'text' AS format
FROM supplier WHERE s_suppkey < 10 HAVING count(*) > 0""",
    "docx_documents": """
SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x{fffe}\\x{ffff}]', ' ', 'g') AS content,
  len(string_split(text, chr(10)))::INT AS paragraphs FROM documents""",
    "report_json": "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type",
    "dataset_by_format": "SELECT doc_id, text, lang FROM documents",
}
