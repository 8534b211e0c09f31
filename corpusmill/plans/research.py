"""Experiment runs, retrieval and prompts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusmill import sinks
from corpusmill.operators import experiments, retrieve, term_index
from corpusmill.plans.common import rounded, sql_list, table
from corpusmill.session import scratch_path

DIMENSIONS = 64


def runs(spark, sf_dir):
    """Events of a user as the runs of a campaign, errors as failed runs."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("campaign_id"),
        F.col("event_id").alias("idx"),
        F.concat(F.lit("exp-"), F.col("event_id").cast("string")).alias("experiment_id"),
        F.col("value").alias("final_loss"),
        (F.col("event_type") == "error").alias("failed"),
    )


def experiment_status(spark, sf_dir):
    return experiments.label_runs(runs(spark, sf_dir)).select("campaign_id", "idx", "val_bpb", "status")


def experiment_best(spark, sf_dir):
    labelled = experiments.label_runs(runs(spark, sf_dir))
    return experiments.best_runs(labelled).select("campaign_id", "experiment_id", "val_bpb", "status")


def experiment_summary(spark, sf_dir):
    return experiments.summarize_runs(experiments.label_runs(runs(spark, sf_dir)))


def experiment_log(spark, sf_dir):
    """Runs written to a log and read back."""
    path = scratch_path(spark, "experiment-log")
    log = runs(spark, sf_dir).select(
        "experiment_id", F.when(~F.col("failed"), F.col("final_loss")).alias("val_bpb"), "final_loss",
        F.when(F.col("failed"), "failed").otherwise("done").alias("status"), F.lit(None).cast("string").alias("parent_id"),
    )
    sinks.write_experiment_log(log, path)
    return sinks.read_experiment_log(spark, path).select("experiment_id", "parent_id", "val_bpb", "final_loss", "status", "total_steps")


def bits_per_byte(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select(
        "event_type",
        F.col("value").alias("loss_nats"),
        F.when(F.col("event_type") == "signup", 0).otherwise(F.octet_length("props")).alias("n_bytes"),
    )
    return rounded(experiments.bits_per_byte(losses, by=["event_type"]), "bpb")


def _centroids(spark, sf_dir):
    means = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(DIMENSIONS)])
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(means.alias("vector"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def retrieve_topk(spark, sf_dir):
    """The vectors nearest to the mean of each label."""
    return rounded(retrieve.retrieve(_vectors(spark, sf_dir), _centroids(spark, sf_dir)), "score")


def _contents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))


def index_chunks(spark, sf_dir):
    """All documents with vectors of their words, written to an index table and read back. A text without words has no norm."""
    path = scratch_path(spark, "chunk-index")
    vectors = term_index.term_vectors(term_index.build_term_index(_contents(spark, sf_dir)))
    chunks = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), F.col("source").alias("source_ref"), F.lit(0).alias("chunk_index")
    ).join(vectors.select(F.col("chunk_id").alias("doc_id"), "vector"), "doc_id", "left")
    sinks.write_index(retrieve.index_chunks(chunks), path)
    return rounded(sinks.read_index(spark, path).select("chunk_id", "doc_id", "norm"), "norm", places=5)


def rag_prompts(spark, sf_dir):
    """Every benchmark text as a question, with the documents nearest by their words as context."""
    contents, asked = _contents(spark, sf_dir), _questions(spark, sf_dir)
    hits = term_index.search_terms(term_index.build_term_index(contents), asked, k=retrieve.TOP_K)
    user = F.struct(F.lit("user").alias("role"), F.col("content").alias("content"))
    prompts = asked.select("query_id", F.array(user).alias("messages"))
    full = retrieve.prompts_with_context(prompts, retrieve.assemble_context(hits, contents))
    return full.select("query_id", F.to_json("messages").alias("messages"))


def text_retrieval(spark, sf_dir):
    """Documents nearest to each benchmark text, by all their words."""
    index = term_index.build_term_index(_contents(spark, sf_dir))
    return rounded(term_index.search_terms(index, _questions(spark, sf_dir), k=retrieve.TOP_K), "score", places=5)


_RUNS = """
WITH runs AS (
  SELECT user_id AS campaign_id, event_id AS idx, 'exp-' || event_id AS experiment_id, value AS final_loss,
    event_type = 'error' AS failed, CASE WHEN event_type <> 'error' THEN value END AS val_bpb FROM events),
seen AS (
  SELECT *, min(val_bpb) OVER w AS best, row_number() OVER (PARTITION BY campaign_id ORDER BY idx) AS n,
    first_value(failed) OVER (PARTITION BY campaign_id ORDER BY idx) AS first_failed
  FROM runs WINDOW w AS (PARTITION BY campaign_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
labelled AS (
  SELECT *, CASE WHEN failed THEN 'failed' WHEN n = 1 THEN 'baseline' WHEN first_failed THEN 'regressed'
    WHEN final_loss < best THEN 'improved' ELSE 'regressed' END AS status FROM seen)"""
_CENTROIDS = f"""
centroids AS (
  SELECT label, list(m ORDER BY i) AS q FROM (
    SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, {DIMENSIONS + 1}) r(i) GROUP BY label, i) GROUP BY label),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT label AS query_id, vec_id AS chunk_id, round(list_cosine_similarity(v, q), {retrieve.SCORE_PLACES}) AS score
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), centroids))"""
_TERMS = f"""
held AS (SELECT doc_id AS doc, unnest(string_split_regex(lower(text), '{term_index.WORD_BREAK}')) AS term FROM documents),
counts AS (SELECT doc, term, count(*) AS n FROM held WHERE term <> '' GROUP BY doc, term),
terms AS (
  SELECT term, round({term_index.SCALE} * ln((SELECT count(*) + 1 FROM documents) / (count(*) + 1))) AS idf FROM counts GROUP BY term),
weights AS (SELECT doc, term, n * idf AS w FROM counts JOIN terms USING (term) WHERE idf > 0),
lengths AS (SELECT doc, sqrt(sum(w * w)) AS length FROM weights GROUP BY doc),
asked AS (
  SELECT item_id, term, count(*) * any_value(idf) AS w FROM (
    SELECT item_id, unnest(string_split_regex(lower(text), '{term_index.WORD_BREAK}')) AS term FROM benchmark) JOIN terms USING (term)
  WHERE idf > 0 GROUP BY item_id, term),
asked_lengths AS (SELECT item_id, sqrt(sum(w * w)) AS length FROM asked GROUP BY item_id),
scores AS (
  SELECT a.item_id AS query_id, d.doc AS chunk_id, round(sum(a.w / x.length * (d.w / y.length)), {term_index.SCORE_PLACES}) AS score
  FROM asked a JOIN asked_lengths x USING (item_id) JOIN weights d ON d.term = a.term JOIN lengths y ON y.doc = d.doc GROUP BY 1, 2),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scores) WHERE rank <= {retrieve.TOP_K})"""

QUERIES = {
    "experiment_status": experiment_status,
    "experiment_best": experiment_best,
    "experiment_summary": experiment_summary,
    "experiment_log": experiment_log,
    "bits_per_byte": bits_per_byte,
    "retrieve_topk": retrieve_topk,
    "index_chunks": index_chunks,
    "rag_prompts": rag_prompts,
    "text_retrieval": text_retrieval,
}

ORACLE = {
    "experiment_status": f"{_RUNS} SELECT campaign_id, idx, val_bpb, status FROM labelled",
    "experiment_best": f"""{_RUNS}
SELECT campaign_id, experiment_id, val_bpb, status FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY val_bpb, idx) AS r FROM labelled WHERE val_bpb IS NOT NULL) WHERE r = 1""",
    "experiment_summary": f"""{_RUNS}
SELECT campaign_id, count(*) AS total_experiments, count(*) FILTER (status = 'improved') AS improvements,
  count(*) FILTER (status = 'regressed') AS regressions, count(*) FILTER (status = 'failed') AS failures,
  min(val_bpb) AS best_val_bpb, first(experiment_id ORDER BY val_bpb, idx) FILTER (val_bpb IS NOT NULL) AS best_experiment_id
FROM labelled GROUP BY campaign_id""",
    "experiment_log": """
SELECT 'exp-' || event_id AS experiment_id, NULL AS parent_id, CASE WHEN event_type <> 'error' THEN value END AS val_bpb,
  value AS final_loss, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, NULL::INT AS total_steps FROM events""",
    "bits_per_byte": f"""
SELECT event_type, sum(n)::BIGINT AS total_bytes, CASE WHEN sum(n) = 0 THEN 'inf'::DOUBLE ELSE round(sum(value) / ({math.log(2)!r} * sum(n)), 6) END AS bpb
FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 0 ELSE strlen(props) END AS n FROM events) GROUP BY event_type""",
    "retrieve_topk": f"""
WITH {_CENTROIDS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 5""",
    "index_chunks": f"""
WITH {_TERMS} SELECT sha256(source || chr(31) || '0' || chr(31) || text) AS chunk_id, doc_id, round(length, 5) AS norm
FROM documents LEFT JOIN lengths ON doc = doc_id""",
    "text_retrieval": f"""
WITH {_TERMS} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM hits""",
    "rag_prompts": f"""
WITH {_TERMS},
contexts AS (
  SELECT query_id, string_agg(text, {sql_list([retrieve.CONTEXT_SEPARATOR])} ORDER BY rank) AS context
  FROM hits JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT item_id AS query_id, to_json(CASE WHEN context IS NULL THEN [{{'role': 'user', 'content': text}}]
  ELSE [{{'role': 'system', 'content': {sql_list([retrieve.CONTEXT_PROMPT])} || context}}, {{'role': 'user', 'content': text}}] END)::VARCHAR AS messages
FROM benchmark LEFT JOIN contexts ON query_id = item_id""",
}
