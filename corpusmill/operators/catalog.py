"""Schema discovery: one row per field of a collection, and the texts made from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.store_types import normalized_json_type, normalized_spark_type, normalized_store_type

SAMPLE_VALUES = 5
SAMPLE_ROWS = 10


@dataclass(frozen=True)
class Collection:
    """A table as a catalog sees it. ``order_by`` makes samples repeatable."""

    frame: DataFrame
    order_by: Sequence[str]
    primary_key: Sequence[str] = ()
    foreign_keys: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> (table, column)
    source_type: str = "table"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


FIELD_TYPE = (
    "database string, collection string, collection_ordinal int, source_type string, ordinal int, field string, store_type string, "
    "data_type string, nullable boolean, is_primary_key boolean, relationships array<string>"
)


def _metadata(database: str, name: str, place: int, collection: Collection) -> list[tuple]:
    related = sorted({target for target, _ in collection.foreign_keys.values()})
    return [
        (
            database,
            name,
            place,
            collection.source_type,
            ordinal,
            column.name,
            column.dataType.simpleString(),
            normalized_spark_type(column.dataType),
            column.nullable and column.name not in collection.primary_key,
            column.name in collection.primary_key,
            related,
        )
        for ordinal, column in enumerate(collection.frame.schema.fields)
    ]


def _samples(database: str, name: str, collection: Collection, size: int) -> DataFrame:
    """One row per field with its values in the first rows, by a top-k on the order columns."""
    keys, columns = list(collection.order_by), collection.frame.columns
    first = collection.frame.orderBy(*keys).limit(size)
    values = F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_row")
    rows = first.agg(F.sort_array(F.collect_list(F.struct(*keys, values))).alias("_rows"))
    per_field = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(f"_rows._row.{c}").alias("sample_values")) for c in columns]
    )
    return rows.select(F.lit(database).alias("database"), F.lit(name).alias("collection"), F.inline(per_field))


def catalog_fields(
    database: str, collections: Mapping[str, Collection], *, samples: int = SAMPLE_VALUES
) -> DataFrame:
    """One row per field, collections numbered in the given order. With ``samples`` also the values of the first rows; without, no data is read."""
    spark = next(iter(collections.values())).frame.sparkSession
    fields = spark.createDataFrame(
        [row for place, (name, c) in enumerate(collections.items()) for row in _metadata(database, name, place, c)], FIELD_TYPE
    )
    if not samples:
        return fields
    seen = reduce(DataFrame.unionByName, [_samples(database, name, c, samples) for name, c in collections.items()])
    return fields.join(seen, ["database", "collection", "field"])


def catalog_tables(database: str, collections: Mapping[str, Collection]) -> DataFrame:
    """One row per collection with its row count."""
    parts = [
        c.frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(database).alias("database"),
            F.lit(name).alias("collection"),
            F.lit(c.source_type).alias("source_type"),
            F.lit(len(c.frame.columns)).alias("n_fields"),
            F.lit(len({t for t, _ in c.foreign_keys.values()})).alias("n_relationships"),
            "row_count",
        )
        for name, c in collections.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def fields_from_metadata(rows: DataFrame, store: str) -> DataFrame:
    """Catalog rows from a store's own column listing (``information_schema`` and the like), given as
    database, collection, ordinal, field, store_type, nullable, is_primary_key. Collections are numbered by name."""
    typed = rows.withColumn("data_type", normalized_store_type(store, F.col("store_type"))).withColumn("source_type", F.lit("table"))
    return numbered_collections(typed.withColumn("relationships", F.array().cast("array<string>")))


def numbered_collections(fields: DataFrame) -> DataFrame:
    """Adds collection_ordinal by name. A catalog has a row per field of a store, so one task holds a database's."""
    place = F.dense_rank().over(Window.partitionBy("database").orderBy("collection")) - 1
    return fields.withColumn("collection_ordinal", place)


def fields_from_json(documents: DataFrame, *, collection: Column, content: Column, order_by: Sequence[str], source_type: str = "collection") -> DataFrame:
    """Fields of the first document of each collection, typed by its values."""
    first = documents.groupBy(collection.alias("collection")).agg(
        F.min_by(content, F.struct(*order_by)).alias("_json"), F.count(F.lit(1)).alias("row_count")
    )
    sample = F.try_parse_json(F.when(F.startswith(F.ltrim("_json"), F.lit("[")), F.get_json_object("_json", "$[0]")).otherwise(F.col("_json")))
    return (
        first.withColumn("_doc", sample)
        .where(F.schema_of_variant("_doc").startswith("OBJECT"))
        .lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("_doc").outer()))
        .select(
            "collection",
            F.lit(source_type).alias("source_type"),
            F.col("pos").alias("ordinal"),
            F.col("key").alias("field"),
            normalized_json_type(F.schema_of_variant("value")).alias("data_type"),
            (F.col("key") == "_id").alias("is_primary_key"),
            "row_count",
        )
    )


def key_value_collections(pairs: DataFrame, *, order_by: str, key: str = "key", kind: str = "type") -> DataFrame:
    """Keys grouped by the part before the first colon; the first key seen gives the type."""
    return (
        pairs.groupBy(F.substring_index(F.col(key), ":", 1).alias("collection"))
        .agg(F.min_by(F.col(kind), F.col(order_by)).alias("store_type"), F.count(F.lit(1)).alias("keys"))
        .select(
            "collection",
            F.lit("collection").alias("source_type"),
            F.lit("value").alias("field"),
            normalized_store_type("redis", F.col("store_type")).alias("data_type"),
            "keys",
        )
    )


def topic_collections(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.col("topic").alias("collection")).agg(F.lit("topic").alias("source_type"), F.count(F.lit(1)).alias("messages"))


def index_fields(mappings: DataFrame, *, content: str = "mapping") -> DataFrame:
    """Fields of search indexes from their mapping documents."""
    schema = "map<string,struct<mappings:struct<properties:map<string,struct<type:string>>>>>"
    return (
        mappings.select(F.explode(F.from_json(content, schema)).alias("collection", "_index"))
        .select("collection", F.explode("_index.mappings.properties").alias("field", "_meta"))
        .select(
            "collection",
            F.lit("index").alias("source_type"),
            "field",
            normalized_store_type("elasticsearch", F.coalesce("_meta.type", F.lit("object"))).alias("data_type"),
        )
    )


def file_collections(files: DataFrame) -> DataFrame:
    """Files (``path``) grouped by extension; the row count is the number of files."""
    name = F.substring_index("path", "/", -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    return (
        files.withColumn("collection", extension)
        .where(F.col("collection").isNotNull() & (F.col("collection") != ""))
        .groupBy("collection")
        .agg(F.lit("bucket").alias("source_type"), F.count(F.lit(1)).alias("row_count"), F.min("path").alias("first_path"))
    )


def describe_tables(fields: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """A sentence or three about each table. ``foreign_keys``: collection, field, ref_table, ref_field."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "field", "store_type")))
    tables = fields.groupBy("collection").agg(ordered.alias("_fields"))
    listed = F.array_join(
        F.transform("_fields", lambda f: F.concat(F.lit("'"), f["field"], F.lit("' ("), f["store_type"], F.lit(")"))), ", "
    )
    head = F.concat(
        F.lit("The '"), F.col("collection"), F.lit("' table stores records with "), F.size("_fields").cast("string"), F.lit(" column(s).")
    )
    parts = [head, F.concat(F.lit("Columns: "), listed, F.lit("."))]
    if foreign_keys is not None:
        links = foreign_keys.groupBy("collection").agg(
            F.sort_array(F.collect_list(F.struct("field", "ref_table", "ref_field"))).alias("_links")
        )
        tables = tables.join(links, "collection", "left")
        named = F.transform(
            "_links", lambda k: F.concat(k["field"], F.lit(" references '"), k["ref_table"], F.lit("' ("), k["ref_field"], F.lit(")"))
        )
        parts.append(F.concat(F.lit("Relationships: "), F.array_join(named, "; "), F.lit(".")))
    return tables.select("collection", F.concat_ws(" ", *parts).alias("description"))


def table_documents(name: str, collection: Collection, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One document for a table: its columns, foreign keys and first rows as text."""
    frame, keys = collection.frame, list(collection.order_by)
    head = [f"Table: {name}", "Columns:"] + [f"  - {f.name} ({f.dataType.simpleString()})" for f in frame.schema.fields]
    if collection.foreign_keys:
        head.append("Foreign Keys:")
        head += [f"  - {column} -> {table}.{ref}" for column, (table, ref) in collection.foreign_keys.items()]
    line = F.concat(F.lit("  "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), _text(c)) for c in frame.columns]))
    first = frame.orderBy(*keys).limit(sample_rows).select(*keys, line.alias("_line"))
    lines = F.sort_array(F.collect_list(F.struct(*keys, "_line")))
    sample = F.when(
        F.size("_lines") > 0,
        F.concat(
            F.lit("\nSample Data ("), F.size("_lines").cast("string"), F.lit(" rows):\n"), F.array_join(F.col("_lines._line"), "\n")
        ),
    ).otherwise("")
    return first.agg(lines.alias("_lines")).select(
        F.concat(F.lit("\n".join(head)), sample).alias("content"),
        F.lit(f"sql://{name}").alias("source_ref"),
        F.create_map(F.lit("table"), F.lit(name), F.lit("row_count"), F.size("_lines").cast("string")).alias("metadata"),
    )


def sql_documents(documents: DataFrame) -> DataFrame:
    """Documents that stand for tables, with the table name."""
    kept = documents.where(F.startswith("source_ref", F.lit("sql://")))
    return kept.withColumn("table", F.substr("source_ref", F.lit(len("sql://") + 1)))
