"""Catalogs of the driver's tables, and what follows from them: descriptions, formats, mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import catalog, detect, mapping
from corpusmill.operators.catalog import Collection
from corpusmill.plans.common import documents, sql_list, table

# table: (order / primary key, foreign keys, columns with their Spark types)
TABLES = {
    "region": (["r_regionkey"], {}, "r_regionkey:int r_name:string"),
    "nation": (["n_nationkey"], {"n_regionkey": ("region", "r_regionkey")}, "n_nationkey:int n_name:string n_regionkey:int"),
    "customer": (
        ["c_custkey"],
        {"c_nationkey": ("nation", "n_nationkey")},
        "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    ),
    "supplier": (
        ["s_suppkey"],
        {"s_nationkey": ("nation", "n_nationkey")},
        "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    ),
    "part": (
        ["p_partkey"],
        {},
        "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    ),
    "orders": (
        ["o_orderkey"],
        {"o_custkey": ("customer", "c_custkey")},
        "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    ),
}
DATABASES = {
    "shop": list(TABLES),
    "articles": ["documents"],
    "chats": ["conversations"],
    "vectors": ["embeddings"],
}
COMMON_TYPE = {"int": "integer", "bigint": "integer", "double": "float", "string": "string", "timestamp_ntz": "datetime"}


def _collection(spark, sf_dir, name):
    keys, links, _ = TABLES[name]
    return Collection(table(spark, sf_dir, name), keys, keys, links)


def _shop(spark, sf_dir):
    return {name: _collection(spark, sf_dir, name) for name in TABLES}


def catalog_fields(spark, sf_dir):
    fields = catalog.catalog_fields("shop", _shop(spark, sf_dir))
    return fields.select(
        "collection",
        "ordinal",
        "field",
        "data_type",
        "is_primary_key",
        F.array_join("sample_values", "|").alias("samples"),
        F.array_join("relationships", ",").alias("relationships"),
    )


def catalog_tables(spark, sf_dir):
    return catalog.catalog_tables("shop", _shop(spark, sf_dir))


def describe_tables(spark, sf_dir):
    fields = catalog.catalog_fields("shop", _shop(spark, sf_dir), samples=0)
    links = [(name, column, *target) for name, (_, keys, _) in TABLES.items() for column, target in keys.items()]
    foreign = spark.createDataFrame(links, "collection string, field string, ref_table string, ref_field string")
    counts = catalog.catalog_tables("shop", _shop(spark, sf_dir)).select("collection", "row_count")
    return catalog.describe_tables(fields, foreign).join(counts, "collection")


def table_documents(spark, sf_dir):
    parts = [catalog.table_documents(name, c) for name, c in _shop(spark, sf_dir).items()]
    tables = catalog.sql_documents(reduce(DataFrame.unionByName, parts))
    return tables.select("table", "content", F.col("metadata")["row_count"].alias("row_count"))


def _databases(spark, sf_dir):
    """The driver's tables as four databases; the chat one under mapped names."""
    frames = {
        "shop": _shop(spark, sf_dir),
        "articles": {"documents": Collection(table(spark, sf_dir, "documents"), ["doc_id"])},
        "chats": {
            "conversations": Collection(
                table(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "session_id", "text": "content"}),
                ["session_id", "turn"],
            )
        },
        "vectors": {"embeddings": Collection(table(spark, sf_dir, "embeddings"), ["vec_id"])},
    }
    fields = reduce(DataFrame.unionByName, [catalog.catalog_fields(db, cs, samples=0) for db, cs in frames.items()])
    counts = reduce(DataFrame.unionByName, [catalog.catalog_tables(db, cs) for db, cs in frames.items()])
    return fields, counts


def detect_format(spark, sf_dir):
    fields, counts = _databases(spark, sf_dir)
    sizes = counts.groupBy("database").agg(F.sum("row_count").alias("row_count"))
    found = detect.detect_formats(fields).select(
        "database",
        "primary_format",
        "confidence",
        F.array_join("alternatives", ",").alias("alternatives"),
        F.array_join(F.transform(F.array_sort(F.map_entries("column_mapping")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(
            "column_mapping"
        ),
        "reasoning",
    )
    return found.join(sizes, "database")


def render_detected(spark, sf_dir):
    """The conversations look like a chat, so their turns become chat records."""
    fields, _ = _databases(spark, sf_dir)
    chunks = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("content"),
        F.col("role").alias("source_ref"),
        F.lit(0).alias("chunk_index"),
    )
    records = detect.render_detected(chunks, fields.where(F.col("database") == "chats"))
    return records.select(F.to_json("messages").alias("messages"), "source_ref")


def _labelled(spark, sf_dir):
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


MAPPING = {"content": "text", "quality": "label", "topic": "category"}


def mapping_report(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    full = mapping.mapping_report(rows, {"content": "text", "source": "ref"}, by=["lang"]).withColumn("mapping", F.lit("full"))
    partly = mapping.mapping_report(rows, {"content": "text", "quality": "label"}, by=["lang"]).withColumn("mapping", F.lit("partly"))
    return full.unionByName(partly).withColumn("coverage_pct", F.round("coverage_pct", 6))


def mapping_errors(spark, sf_dir):
    return mapping.mapping_errors(_labelled(spark, sf_dir), MAPPING, keep=["doc_id"]).select("doc_id", "field", "error_type")


def _sql_fields() -> str:
    parts = []
    for name, (keys, links, columns) in TABLES.items():
        related = ",".join(sorted({t for t, _ in links.values()}))
        for i, column in enumerate(columns.split()):
            field, kind = column.split(":")
            parts.append(
                f"SELECT '{name}' AS collection, {i}::INT AS ordinal, '{field}' AS field, '{COMMON_TYPE[kind]}' AS data_type, "
                f"{str(field in keys).lower()} AS is_primary_key, (SELECT string_agg(CAST({field} AS VARCHAR), '|' ORDER BY {keys[0]}) "
                f"FROM (SELECT * FROM {name} ORDER BY {keys[0]} LIMIT 5)) AS samples, '{related}' AS relationships"
            )
    return " UNION ALL ".join(parts)


def _sql_tables() -> str:
    return " UNION ALL ".join(
        f"SELECT 'shop' AS database, '{name}' AS collection, 'table' AS source_type, {len(columns.split())}::INT AS n_fields, "
        f"{len({t for t, _ in links.values()})}::INT AS n_relationships, count(*) AS row_count FROM {name}"
        for name, (_, links, columns) in TABLES.items()
    )


def _sql_descriptions() -> str:
    parts = []
    for name, (_, links, columns) in TABLES.items():
        listed = ", ".join("'{}' ({})".format(*c.split(":")) for c in columns.split())
        text = f"The '{name}' table stores records with {len(columns.split())} column(s). Columns: {listed}."
        if links:
            text += " Relationships: " + "; ".join(f"{c} references '{t}' ({r})" for c, (t, r) in sorted(links.items())) + "."
        parts.append(f"SELECT '{name}' AS collection, {sql_list([text])} AS description, count(*) AS row_count FROM {name}")
    return " UNION ALL ".join(parts)


def _sql_table_documents() -> str:
    parts = []
    for name, (keys, links, columns) in TABLES.items():
        lines = [f"Table: {name}", "Columns:"] + ["  - {} ({})".format(*c.split(":")) for c in columns.split()]
        if links:
            lines += ["Foreign Keys:"] + [f"  - {c} -> {t}.{r}" for c, (t, r) in links.items()]
        head = " || chr(10) || ".join(sql_list([line]) for line in lines)
        row = " || ', ' || ".join(
            f"'{c.split(':')[0]}=' || coalesce(CAST({c.split(':')[0]} AS VARCHAR), 'None')" for c in columns.split()
        )
        parts.append(
            f"SELECT '{name}' AS \"table\", {head} || chr(10) || 'Sample Data (' || count(*) || ' rows):' || chr(10) || "
            f"string_agg('  ' || {row}, chr(10) ORDER BY {keys[0]}) AS content, CAST(count(*) AS VARCHAR) AS row_count "
            f"FROM (SELECT * FROM {name} ORDER BY {keys[0]} LIMIT 10)"
        )
    return " UNION ALL ".join(parts)


_DETECTED = """
SELECT 'shop' AS database, 'text2sql' AS primary_format, 0.9::DOUBLE AS confidence, '' AS alternatives, 'schema=context' AS column_mapping,
  'Database has 6 tables with relationships, suitable for text2sql.' AS reasoning,
  (SELECT sum(row_count)::BIGINT FROM ({tables})) AS row_count
UNION ALL SELECT 'articles', 'corpus', 0.5, '', 'text=text', 'Table ''documents'' has a single text field (text).', (SELECT count(*) FROM documents)
UNION ALL SELECT 'chats', 'chat', 0.95, 'corpus', 'content=content,role=role,session_id=session_id',
  'Collection ''conversations'' has role/content/session_id columns, indicating chat format.', (SELECT count(*) FROM conversations)
UNION ALL SELECT 'vectors', 'corpus', 0.2, 'dpo,qa,instruction,chat,text2sql', '',
  'No strong pattern detected (best match: corpus at 0.20). Falling back to corpus format.', (SELECT count(*) FROM embeddings)"""


def _sql_report(label, missing):
    return f"""
SELECT lang, '{label}' AS mapping, count(*) AS total_records, count(*) FILTER ({missing}) AS invalid_records,
  count(*) FILTER (NOT ({missing})) AS valid_records,
  count(*) FILTER (NOT ({missing})) / count(*) * 100.0 AS pct
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""


from corpusmill.operators.formats import CHAT_SYSTEM, CHAT_TEMPLATES  # noqa: E402
from corpusmill.plans.training import _TOPIC, _rotated  # noqa: E402

QUERIES = {
    "catalog_fields": catalog_fields,
    "catalog_tables": catalog_tables,
    "describe_tables": describe_tables,
    "table_documents": table_documents,
    "detect_format": detect_format,
    "render_detected": render_detected,
    "mapping_report": mapping_report,
    "mapping_errors": mapping_errors,
}

ORACLE = {
    "catalog_fields": _sql_fields(),
    "catalog_tables": _sql_tables(),
    "describe_tables": _sql_descriptions(),
    "table_documents": _sql_table_documents(),
    "detect_format": _DETECTED.format(tables=_sql_tables()),
    "render_detected": f"""
WITH placed AS (SELECT *, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS position FROM conversations)
SELECT to_json([{{'role': 'system', 'content': '{CHAT_SYSTEM}'}},
  {{'role': 'user', 'content': {_rotated(CHAT_TEMPLATES, 'topic', _TOPIC)}}},
  {{'role': 'assistant', 'content': text}}])::VARCHAR AS messages, role AS source_ref FROM placed""",
    "mapping_report": f"""
SELECT lang, mapping, total_records, invalid_records, valid_records, round(pct, 6) AS coverage_pct, pct >= 99 AS approved,
  CASE WHEN pct = 100 THEN NULL
    WHEN pct >= 99 THEN printf('Coverage is %.1f%% — auto-approved with notification. %d record(s) have issues.', pct, invalid_records)
    WHEN pct >= 95 THEN printf('Coverage is %.1f%% — needs explicit approval. %d record(s) have issues.', pct, invalid_records)
    ELSE printf('Coverage is %.1f%% — blocked. Too many invalid records (%d/%d).', pct, invalid_records, total_records) END AS warning
FROM ({_sql_report('full', 'text IS NULL OR source IS NULL')} UNION ALL {_sql_report('partly', 'text IS NULL OR quality IS NULL')})""",
    "mapping_errors": """
SELECT doc_id, 'quality' AS field, 'null_value' AS error_type FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
UNION ALL SELECT doc_id, 'topic', 'missing_column' FROM documents""",
}
