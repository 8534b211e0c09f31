"""Fetch from tables: which rows and columns, over JDBC or from any frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FetchQuery:
    """``filters`` are equalities that all have to hold. An offset needs ``order_by``."""

    collection: str
    columns: Sequence[str] | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)
    limit: int | None = None
    offset: int = 0
    order_by: Sequence[str] = ()
    raw_query: str | None = None


def select_rows(df: DataFrame, query: FetchQuery) -> DataFrame:
    """Filter, then offset and limit, then columns. Filters and columns reach the scan."""
    for name, value in query.filters.items():
        df = df.where(F.col(name) == F.lit(value))
    if query.offset and not query.order_by:
        raise ValueError("an offset needs order_by: rows have no order of their own")
    if query.order_by and (query.offset or query.limit is not None):
        df = df.orderBy(*query.order_by)
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    return df.select(*query.columns) if query.columns else df


# Store -> (url pattern, default port, driver class).
JDBC_STORES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521, "oracle.jdbc.OracleDriver"),
    "sqlite": ("jdbc:sqlite:{database}", None, "org.sqlite.JDBC"),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", 5439, "com.amazon.redshift.jdbc.Driver"),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}", None, "net.snowflake.client.jdbc.SnowflakeDriver"),
    "bigquery": (
        "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:{port};ProjectId={host};DefaultDataset={database}",
        443,
        "com.simba.googlebigquery.jdbc.Driver",
    ),
}


def jdbc_options(
    store: str,
    query: FetchQuery,
    *,
    host: str = "localhost",
    port: int | None = None,
    database: str = "",
    user: str | None = None,
    password: str | None = None,
    url: str | None = None,
    split_by: tuple[str, Any, Any, int] | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read. ``split_by`` (column, lower, upper, partitions) reads in parallel
    ranges instead of through one cursor."""
    pattern, default_port, driver = JDBC_STORES[store]
    options = {
        "url": url or pattern.format(host=host, port=port or default_port, database=database or (":memory:" if store == "sqlite" else "")),
        "driver": driver,
        "fetchsize": str(fetch_size),
    }
    if user is not None:
        options["user"], options["password"] = user, password or ""
    if query.raw_query and split_by:
        options["dbtable"] = f"({query.raw_query}) fetched"
    elif query.raw_query:
        options["query"] = query.raw_query
    else:
        options["dbtable"] = query.collection
    if split_by:
        column, lower, upper, partitions = split_by
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, store: str, query: FetchQuery, **connection: Any) -> DataFrame:
    """Rows of a SQL store; the driver jar comes with the session. A raw query stands for itself."""
    rows = spark.read.format("jdbc").options(**jdbc_options(store, query, **connection)).load()
    return rows if query.raw_query else select_rows(rows, query)


def _shown(column: T.StructField) -> Column:
    value = F.col(column.name)
    if isinstance(column.dataType, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(column.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("None"))


def row_documents(rows: DataFrame, *, store: str, table: str, keep: Sequence[str] = ()) -> DataFrame:
    """Table rows as documents: ``name=value`` pairs as text, the row itself as JSON."""
    fields = [f for f in rows.schema.fields]
    pairs = [F.concat(F.lit(f"{f.name}="), _shown(f)) for f in fields]
    return rows.select(
        *keep,
        F.concat_ws(", ", *pairs).alias("content"),
        F.create_map(F.lit("table"), F.lit(table), F.lit("columns"), F.lit(",".join(f.name for f in fields))).alias("metadata"),
        F.to_json(F.struct(*[f.name for f in fields]), {"ignoreNullFields": "false"}).alias("row"),
        F.lit(f"{store}://{table}").alias("source_ref"),
    )


def record_documents(rows: DataFrame, *, store: str, collection: str, key: str = "collection", keep: Sequence[str] = ()) -> DataFrame:
    """Records of a document store as documents: JSON text with nulls kept."""
    return rows.select(
        *keep,
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("content"),
        F.create_map(F.lit(key), F.lit(collection)).alias("metadata"),
        F.lit(f"{store}://{collection}").alias("source_ref"),
    )


def match_text(df: DataFrame, clauses: Mapping[str, str]) -> DataFrame:
    """Full-text clauses as a search store reads them: any word of the clause occurs in the field."""
    word_gap = r"[^\p{L}\p{N}_]+"
    for name, clause in clauses.items():
        held = F.split(F.lower(F.col(name).cast("string")), word_gap)
        asked = F.filter(F.split(F.lower(F.lit(str(clause))), word_gap), lambda w: w != "")
        df = df.where(F.arrays_overlap(held, asked))
    return df


def fetch_since(df: DataFrame, *, key: str, checkpoint: Any) -> DataFrame:
    """Rows whose key lies beyond the checkpoint (all rows without one)."""
    return df if checkpoint is None else df.where(F.col(key) > F.lit(checkpoint))


def next_checkpoint(df: DataFrame, *, key: str, checkpoint: Any = None) -> DataFrame:
    """One row: the key to continue from, and the rows that led there. The old one stays without new rows."""
    fresh = fetch_since(df, key=key, checkpoint=checkpoint)
    old = F.lit(checkpoint).cast(df.schema[key].dataType)
    return fresh.agg(F.coalesce(F.max(key), old).alias("checkpoint"), F.count(F.lit(1)).alias("rows"))
