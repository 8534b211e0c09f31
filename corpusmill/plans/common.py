"""Helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white-space characters of corpusmill.functions.text, in the two notations the SQL side needs.
SQL_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_WS_CHARS = " || ".join(
    f"chr({code})"
    for code in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {SQL_WS_CHARS})"


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '{SQL_WS}+'), lambda t: t <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the document layout."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), F.concat(F.lit("documents://"), F.col("source")).alias("source_ref"), "lang", "source"
    )


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), places) for name in names})


def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)
