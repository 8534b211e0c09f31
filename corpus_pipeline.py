"""From raw documents to packed training sequences: five stages, each one operator of ``corpusmill.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, line_dedup, near_dedup, packing, quality
from corpusmill.llm.queries import WORD_TOKENIZER, tokenizer
from corpusmill.session import scratch_path


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``; rows without doc_id, which cannot be named, go."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the likelihood ratio go."""
    return _only(docs, quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept"))


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; n_chars follows."""
    done = line_dedup.drop_recurring(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, the first stays."""
    return _only(docs, near_dedup.near_duplicates(docs).where("kept"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of packed sequences."""
    return packing.pack(docs, tokenizer(WORD_TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", recurring_lines),
    ("near dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

#: Hashed n-grams, signatures and tokenizers cannot be put in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each result but the last is kept as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
