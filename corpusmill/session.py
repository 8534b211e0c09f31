"""Session settings and the shared folder used for cut lineage and stream state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def local_session(
    cpus: str | int = "*", *, shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str = LOCAL_CHECKPOINTS
) -> SparkSession:
    """A local session for tests and the bench, with its checkpoint folder set. Clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("corpusmill")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config(CHECKPOINT_KEY, checkpoints)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if configured is None:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors when the session is built")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_parts(df: DataFrame, size: int, most: int) -> DataFrame:
    """``df``, a table in the shared folder, in no more partitions than its ``size`` asks for at ``most`` a task. In a single one, grouping and joining need no exchange."""
    return df.coalesce(max(1, -(-size // most)))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: like cut_lineage, for tables of which columns are read one by one."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
