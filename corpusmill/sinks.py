"""Where results go. Every writer is a plain Spark write, so it is parallel and can be retried."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of an experiment log.
LOG_TYPES = {
    "experiment_id": "string",
    "parent_id": "string",
    "description": "string",
    "val_bpb": "double",
    "val_loss": "double",
    "domain_score": "double",
    "final_loss": "double",
    "total_steps": "int",
    "training_time_s": "double",
    "status": "string",
    "reasoning": "string",
    "timestamp": "string",
}

LOG_LAYOUT = {"sep": "\t", "header": True, "nullValue": "", "escape": '"'}


def write_report(report: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Report rows as JSON lines, nulls included, with the time of writing."""
    report.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode(
        mode
    ).option("ignoreNullFields", "false").json(path)


def write_experiment_log(runs: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append runs to a tab-separated log; missing columns and nulls are blank."""
    columns = [
        (F.col(name) if name in runs.columns else F.lit(None)).cast(kind).alias(name) for name, kind in LOG_TYPES.items()
    ]
    runs.select(*columns).write.mode(mode).csv(path, **LOG_LAYOUT, emptyValue="")


def read_experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with types; blanks become null."""
    schema = ", ".join(f"{name} {kind}" for name, kind in LOG_TYPES.items())
    return spark.read.csv(path, **LOG_LAYOUT, schema=schema, multiLine=True)


def write_dataset(records: DataFrame, path: str, *, file_format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Hand training records over as parquet or JSON lines."""
    records.write.mode(mode).partitionBy(*partition_by).format(file_format).save(path)


MANIFEST = "collection string, run string, snapshot long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], MANIFEST)


def _folder(name: str) -> str:
    """A partition value that is read back as text, also where the name looks like a number."""
    return f"_{name}"


def _write_run(rows: DataFrame, path: str, kind: str, collection: str, run: str | None) -> str:
    """Write a run's rows, then enter it in the manifest, unless it is there. A run that is not in the manifest is not read."""
    run = run or uuid.uuid4().hex
    named = rows.withColumns({"collection": F.lit(_folder(collection)), "run": F.lit(_folder(run))})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "run").parquet(f"{path}/{kind}")
    manifest = _manifest(rows.sparkSession, path).where(F.col("collection") == collection)
    if manifest.where(F.col("run") == run).isEmpty():
        last = manifest.agg(F.max("snapshot")).first()[0] or 0
        rows.sparkSession.createDataFrame([(collection, run, last + 1)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def write_index(chunks: DataFrame, path: str, *, collection: str = "default", run: str | None = None) -> str:
    """Add indexed chunks to a collection of the index table and return the name of the run.

    Every run makes a snapshot, in the order of writing; a chunk_id that comes again replaces its earlier row. A write without a name is a
    run of its own. A repeated run (after a failure) replaces its own rows and keeps its place. One writer per collection at a time.
    """
    return _write_run(chunks, path, "rows", collection, run)


def delete_from_index(chunk_ids: DataFrame, path: str, *, collection: str = "default", run: str | None = None) -> str:
    """Mark the chunks named by ``chunk_id`` as deleted from this snapshot on; earlier snapshots, and later writes, still show them."""
    return _write_run(chunk_ids.select("chunk_id").distinct(), path, "deleted", collection, run)


def index_snapshots(spark: SparkSession, path: str, *, collection: str = "default") -> DataFrame:
    """Runs of a collection with their snapshot numbers."""
    return _manifest(spark, path).where(F.col("collection") == collection).select("snapshot", "run").orderBy("snapshot")


def read_index(spark: SparkSession, path: str, *, collection: str = "default", snapshot: int | None = None) -> DataFrame:
    """A collection's chunks as of a snapshot (by default the last one): each from the newest run that wrote it, if none deleted it since."""
    runs = index_snapshots(spark, path, collection=collection).select(F.concat(F.lit(_folder("")), "run").alias("run"), F.col("snapshot").alias("_snapshot"))
    if snapshot is not None:
        runs = runs.where(F.col("_snapshot") <= snapshot)
    rows = spark.read.parquet(f"{path}/rows").where(F.col("collection") == _folder(collection)).join(runs, "run")
    events = rows.select("chunk_id", "_snapshot", F.lit(False).alias("_gone"))
    try:
        gone = spark.read.parquet(f"{path}/deleted").where(F.col("collection") == _folder(collection)).join(runs, "run")
        events = events.unionByName(gone.select("chunk_id", "_snapshot", F.lit(True).alias("_gone")))
    except AnalysisException:  # nothing was deleted yet
        pass
    newest = events.groupBy("chunk_id").agg(F.max(F.struct("_snapshot", "_gone")).alias("_last"))
    newest = newest.where("NOT _last._gone").select("chunk_id", F.col("_last._snapshot").alias("_snapshot"))
    return rows.join(newest, ["chunk_id", "_snapshot"]).drop("collection", "run", "_snapshot")
