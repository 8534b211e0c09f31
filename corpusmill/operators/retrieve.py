"""Chunk index, nearest chunks per query, and prompts built from them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.vector_index import SCORE_PLACES, build_vector_index, search

# The frame of a prompt with retrieved context.
CONTEXT_SEPARATOR = "\n\n---\n\n"
CONTEXT_PROMPT = (
    "Use the following context to help answer the user's question. "
    "If the context doesn't contain relevant information, answer based on your training.\n\n"
    "Context:\n"
)
TOP_K = 5
__all__ = ["SCORE_PLACES", "TOP_K", "assemble_context", "fit_text_vectors", "index_chunks", "prompts_with_context", "retrieve", "text_vectors"]


def index_chunks(chunks: DataFrame, *, vector: str = "vector") -> DataFrame:
    """Chunks with a reproducible id and the norm of their vector."""
    identity = F.concat_ws("\x1f", "source_ref", F.col("chunk_index").cast("string"), "content")
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return chunks.withColumn("chunk_id", F.sha2(identity, 256)).withColumn("norm", F.sqrt(squares))


def fit_text_vectors(texts: DataFrame, *, content: str = "content", features: int = 512) -> PipelineModel:
    """Hashed, idf-weighted word counts of unit length, for texts that come without vectors."""
    stages = [
        RegexTokenizer(inputCol=content, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(texts)


def text_vectors(model: PipelineModel, texts: DataFrame) -> DataFrame:
    vectors = model.transform(texts).withColumn("vector", vector_to_array("_unit", "float32"))
    return vectors.drop("_words", "_counts", "_weights", "_unit")


def retrieve(index: DataFrame, queries: DataFrame, *, k: int = TOP_K, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """The ``k`` chunks nearest by cosine for every query: query_id, chunk_id, score, rank.

    ``index`` has chunk_id and vector, ``queries`` query_id and vector. The chunks are put into a vector index first; to search one
    more than once, build it with ``vector_index.write_vector_index``. Exact unless ``probes`` names a number of cells.
    """
    return search(build_vector_index(index, cells=cells), queries, k=k, probes=probes)


def assemble_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The contents of the hits of each query in rank order as one context."""
    found = hits.join(chunks.select("chunk_id", "content"), "chunk_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "content")))  # k chunks per query
    return found.groupBy("query_id").agg(F.array_join(ordered["content"], CONTEXT_SEPARATOR).alias("context"))


def prompts_with_context(prompts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Put the context as a system message before ``messages``; without context they stay as they are."""
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit(CONTEXT_PROMPT), F.col("context")).alias("content"))
    joined = prompts.join(contexts, "query_id", "left")
    extended = F.when(F.col("context").isNull(), F.col("messages")).otherwise(F.concat(F.array(system), F.col("messages")))
    return joined.withColumn("messages", extended).drop("context")
