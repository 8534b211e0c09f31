"""Scores, comparisons and verdicts.

The driver's tables hold no model outputs, so they are derived on both sides: every user turn of a
conversation is a prompt, the assistant turn after it, if there is one, the reference, and four "models" answer. Some references and
some predictions are missing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import consistency, latency, metrics, verdicts
from corpusmill.plans.common import rounded, sql_strip, sql_tokens, table


def samples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")
    )
    words = F.split("reference", " ")
    longer = F.array_join(F.filter(words, lambda w: F.length(w) > 3), " ")
    shorter = F.array_join(F.filter(words, lambda w: F.length(w) <= 3), " ")
    padded = F.when(F.length("reference") % 7 != 0, F.concat(F.lit(" \t"), F.col("reference"), F.lit("\n")))
    answers = F.array(
        *[
            F.struct(F.lit(model).alias("model_id"), text.alias("prediction"))
            for model, text in (("content_words", longer), ("short_words", shorter), ("padded", padded), ("echo", F.col("prompt")))
        ]
    )
    return (
        asked.join(answered, ["conv_id", "turn"], "left")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "prompt", "reference", F.inline(answers))
        .withColumn("baseline", F.col("prompt"))
    )


def labelled(spark, sf_dir):
    """Quality labels against rules on document length; the baseline says 1 to everything. Most documents have no label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    guesses = F.array(
        *[
            F.struct(
                F.lit(f"length_{size}").alias("model_id"),
                F.when(F.col("n_chars") % 11 != 0, (F.col("n_chars") >= size).cast("int").cast("string")).alias("prediction"),
            )
            for size in (200, 1000, 4000)
        ]
    )
    return (
        docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("string").alias("reference"), F.inline(guesses))
        .withColumn("baseline", F.lit(" 1 "))
    )


def responses(spark, sf_dir):
    """Turns of one role in one conversation as responses to one prompt."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("role").alias("model_id"), F.col("conv_id").alias("prompt_id"), F.col("turn").alias("response_idx"), F.col("text").alias("response")
    )


def sample_correctness(spark, sf_dir):
    rows = metrics.correctness(samples(spark, sf_dir))
    return rows.select("model_id", "sample_id", "prediction", "reference", "correct")


def exact_match(spark, sf_dir):
    return rounded(metrics.exact_match(samples(spark, sf_dir)), "exact_match")


def qa_metrics(spark, sf_dir):
    return rounded(metrics.qa_metrics(samples(spark, sf_dir)), "exact_match", "f1")


def bleu(spark, sf_dir):
    return rounded(metrics.generation_metrics(samples(spark, sf_dir)).select("model_id", "bleu"), "bleu")


def rouge_1(spark, sf_dir):
    return rounded(metrics.generation_metrics(samples(spark, sf_dir)).select("model_id", "rouge_1"), "rouge_1")


def rouge_l(spark, sf_dir):
    return rounded(metrics.generation_metrics(samples(spark, sf_dir)).select("model_id", "rouge_l"), "rouge_l")


def token_f1(spark, sf_dir):
    scored = samples(spark, sf_dir).select("model_id", "sample_id", metrics.token_f1("prediction", "reference").alias("f1"))
    return rounded(scored, "f1")


def classification_metrics(spark, sf_dir):
    found = metrics.classification_metrics(labelled(spark, sf_dir))
    return rounded(found, "accuracy", "precision", "recall", "f1")


def task_types(spark, sf_dir):
    both = samples(spark, sf_dir).select("model_id", "reference").unionByName(
        labelled(spark, sf_dir).select("model_id", "reference")
    )
    return rounded(metrics.task_types(both), "mean_length")


def comparison_rows(spark, sf_dir):
    rows = metrics.compare_samples(samples(spark, sf_dir))
    return rows.select("model_id", "sample_id", "prompt", "baseline", "prediction", "reference", "winner")


def win_loss(spark, sf_dir):
    return metrics.win_loss(labelled(spark, sf_dir))


def improvement(spark, sf_dir):
    rows = samples(spark, sf_dir)
    names = ["exact_match", "f1"]
    tuned = metrics.long_metrics(metrics.qa_metrics(rows), names)
    base = metrics.long_metrics(metrics.qa_metrics(rows, prediction="baseline"), names)
    return metrics.improvement(tuned, base)


def faithfulness(spark, sf_dir):
    return rounded(metrics.faithfulness(samples(spark, sf_dir)), "faithfulness", "hallucination_rate")


def hallucination_flags(spark, sf_dir):
    return metrics.hallucinations(samples(spark, sf_dir)).select("model_id", "sample_id", "overlap")


def alignment_report(spark, sf_dir):
    """Only the longer turns have a reference."""
    turns = table(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id")
    predictions = turns.select(F.col("role").alias("model_id"), key, F.col("text").alias("prediction"))
    references = turns.where(F.length("text") > 200).select(key, F.col("text").alias("reference"))
    return metrics.alignment_report(metrics.align(predictions, references))


def self_consistency(spark, sf_dir):
    return rounded(consistency.self_consistency(responses(spark, sf_dir)), "consistency")


def divergent_prompts(spark, sf_dir):
    scores = consistency.self_consistency(responses(spark, sf_dir))
    return consistency.divergent_prompts(scores).select("model_id", "prompt_id", "responses", "consistency")


def exact_consistency(spark, sf_dir):
    """Text sizes in hundreds as answers, so that some agree."""
    size = F.floor(F.length("response") / 100).cast("string")
    sized = responses(spark, sf_dir).withColumn("response", F.concat(F.lit(" "), size))
    return rounded(consistency.exact_consistency(sized), "consistency")


def consistency_check(spark, sf_dir):
    scores = consistency.mean_consistency(consistency.exact_consistency(responses(spark, sf_dir)))
    checked = scores.withColumn("check", verdicts.consistency_check(F.col("consistency")))
    return rounded(checked, "consistency")


def latency_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("model_id"), F.col("value").alias("duration_ms"))
    return latency.latency_stats(events)


def latency_by_user(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("duration_ms"))
    return latency.latency_stats(events, by=["user_id"])


def format_compliance(spark, sf_dir):
    props = table(spark, sf_dir, "events").select(F.lit("json").alias("expected_format"), F.col("props").alias("output"))
    texts = table(spark, sf_dir, "documents").select(
        F.explode(F.array(F.lit(" List"), F.lit("text"), F.lit("JSON"))).alias("expected_format"), F.col("text").alias("output")
    )
    return rounded(metrics.format_compliance(props.unionByName(texts), by=["expected_format"]), "format_compliance")


def responses_by_model(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumnRenamed("sample_id", "prompt_id")
    return metrics.responses_by_model(rows, ["content_words", "echo", "padded", "short_words"], response="prediction")


def grade_models(spark, sf_dir):
    qa = metrics.long_metrics(metrics.qa_metrics(samples(spark, sf_dir)), ["exact_match", "f1"])
    names = ["accuracy", "precision", "recall", "f1"]
    classes = metrics.long_metrics(metrics.classification_metrics(labelled(spark, sf_dir)), names)
    plain = metrics.long_metrics(metrics.faithfulness(samples(spark, sf_dir)), ["faithfulness"])
    plain = plain.withColumn("model_id", F.concat("model_id", F.lit("_words")))
    return verdicts.grade_metrics(qa.unionByName(classes).unionByName(plain))


def validation_report(spark, sf_dir):
    report = verdicts.validation_report(samples(spark, sf_dir))
    return rounded(report, "exact_match", "f1", "faithfulness", "hallucination_rate", "improvement_pct")


def validation_report_classes(spark, sf_dir):
    """Task type found per model; with latencies and consistency."""
    rows = labelled(spark, sf_dir)
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("length_"), F.when(F.col("user_id") > 50, 200).otherwise(1000).cast("string")).alias("model_id"),
        F.col("value").alias("duration_ms"),
    )
    agreed = rows.select("model_id", F.col("reference").alias("prompt_id"), F.col("prediction").alias("response"))
    report = verdicts.validation_report(
        rows,
        task_type=None,
        consistency=consistency.mean_consistency(consistency.exact_consistency(agreed)),
        latency=latency.latency_stats(events),
    )
    names = ["exact_match", "f1", "accuracy", "precision", "recall", "faithfulness", "hallucination_rate", "improvement_pct", "consistency"]
    return rounded(report, *names)


_SAMPLES = """
WITH base AS (
  SELECT u.conv_id * 1000 + u.turn AS sample_id, u.text AS prompt, a.text AS reference, string_split(a.text, ' ') AS words
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
samples AS (
  SELECT sample_id, prompt, reference, 'content_words' AS model_id,
    array_to_string(list_filter(words, lambda w: length(w) > 3), ' ') AS prediction, prompt AS baseline FROM base
  UNION ALL SELECT sample_id, prompt, reference, 'short_words',
    array_to_string(list_filter(words, lambda w: length(w) <= 3), ' '), prompt FROM base
  UNION ALL SELECT sample_id, prompt, reference, 'padded',
    CASE WHEN length(reference) % 7 <> 0 THEN ' ' || chr(9) || reference || chr(10) END, prompt FROM base
  UNION ALL SELECT sample_id, prompt, reference, 'echo', prompt, prompt FROM base)"""

_LABELLED = """
WITH samples AS (
  SELECT doc_id AS sample_id, quality::VARCHAR AS reference, 'length_' || size AS model_id,
    CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars >= size THEN '1' ELSE '0' END AS prediction, ' 1 ' AS baseline
  FROM documents LEFT JOIN labels USING (doc_id), (VALUES (200), (1000), (4000)) sizes(size))"""


def _norm(expr: str) -> str:
    return f"lower({sql_strip(expr)})"


def _same(left: str, right: str = "reference") -> str:
    return f"coalesce({_norm(left)} = {_norm(right)}, false)"


def _f1(name: str, prediction: str) -> str:
    """CTEs that end in ``name`` (model_id, sample_id, f1)."""
    return f"""
{name}_t AS (
  SELECT model_id, sample_id, {sql_tokens(prediction)} AS p, {sql_tokens('reference')} AS r FROM samples),
{name}_c AS (
  SELECT model_id, sample_id, w, count(*) FILTER (side = 'p') AS np, count(*) FILTER (side = 'r') AS nr FROM (
    SELECT model_id, sample_id, 'p' AS side, unnest(p) AS w FROM {name}_t
    UNION ALL SELECT model_id, sample_id, 'r', unnest(r) FROM {name}_t) GROUP BY ALL),
{name}_s AS (SELECT model_id, sample_id, sum(least(np, nr)) AS shared FROM {name}_c GROUP BY ALL),
{name} AS (
  SELECT model_id, sample_id, CASE WHEN p IS NULL OR r IS NULL THEN 0.0 WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN len(p) = 0 OR len(r) = 0 THEN 0.0
    ELSE 2.0::DOUBLE * shared / (len(p) + len(r)) END AS f1
  FROM {name}_t LEFT JOIN {name}_s USING (model_id, sample_id))"""


def _overlap(left: str, right: str) -> str:
    a, b = f"list_distinct({sql_tokens(left)})", f"list_distinct({sql_tokens(right)})"
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN 0.0 WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"


_QA = f"""
{_f1('f1s', 'prediction')},
qa AS (
  SELECT model_id, avg({_same('prediction')}::INT) AS em, avg(f1) AS f1 FROM samples JOIN f1s USING (model_id, sample_id) GROUP BY model_id)"""
_BASE_QA = f"""
{_f1('f1b', 'baseline')},
base_qa AS (
  SELECT model_id, avg({_same('baseline')}::INT) AS em, avg(f1) AS f1 FROM samples JOIN f1b USING (model_id, sample_id) GROUP BY model_id)"""


def _places(expr: str, places: int) -> str:
    """Rounded by the binary value, as printf does."""
    return f"printf('%.{places}f', {expr})::DOUBLE"


def _gain(tuned: str, base: str) -> str:
    return (
        f"CASE WHEN {base} = 0 THEN CASE WHEN {tuned} > 0 THEN 'inf'::DOUBLE ELSE 0.0 END "
        f"ELSE {_places(f'({tuned} - {base}) / {base} * 100', 2)} END"
    )


def _classes(name: str, prediction: str) -> str:
    return f"""
{name}_n AS (SELECT model_id, {_norm(prediction)} AS p, {_norm('reference')} AS r FROM samples),
{name}_l AS (
  SELECT s.model_id, l.r AS label, count(*) FILTER (s.r = l.r) AS support, count(*) FILTER (s.p = l.r) AS claimed,
    count(*) FILTER (s.p = l.r AND s.r = l.r) AS hit
  FROM {name}_n s JOIN (SELECT DISTINCT model_id, r FROM {name}_n WHERE r IS NOT NULL) l ON s.model_id = l.model_id GROUP BY ALL),
{name}_m AS (
  SELECT model_id, sum(hit)::DOUBLE / any_value(n) AS accuracy,
    avg(CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END) AS precision, avg(hit / support) AS recall
  FROM {name}_l JOIN (SELECT model_id, count(*) AS n FROM {name}_n GROUP BY model_id) USING (model_id) GROUP BY model_id),
{name} AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM {name}_m)"""


def _latency(relation: str) -> str:
    """Linear interpolation written out over the sorted list."""

    def percentile(q: float) -> str:
        k = f"({q}::DOUBLE * (n - 1))"
        low, high = f"s[floor({k})::BIGINT + 1]", f"s[least(floor({k})::BIGINT + 1, n - 1) + 1]"
        return _places(f"{low} + ({k} - floor({k})) * ({high} - {low})", 2)

    return f"""
SELECT model_id, n AS measurements, {percentile(0.5)} AS p50_ms, {percentile(0.95)} AS p95_ms, {percentile(0.99)} AS p99_ms,
  {_places('total / n', 2)} AS mean_ms
FROM (SELECT model_id, list(v ORDER BY v) AS s, count(*) AS n, sum(v::DECIMAL(19, 9))::DOUBLE AS total FROM ({relation}) GROUP BY model_id)"""


def _exact_consistency(relation: str) -> str:
    return f"""
SELECT model_id, prompt_id, sum(n)::BIGINT AS responses,
  CASE WHEN sum(n) < 2 THEN 1.0 ELSE sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2) END AS consistency
FROM (SELECT model_id, prompt_id, {_norm('response')} AS answer, count(*) AS n FROM ({relation}) GROUP BY ALL) GROUP BY model_id, prompt_id"""


_RESPONSES = "SELECT role AS model_id, conv_id AS prompt_id, turn AS idx, text AS response FROM conversations"
_SELF = f"""
WITH r AS ({_RESPONSES}),
pairs AS (
  SELECT a.model_id, a.prompt_id, {_overlap('a.response', 'b.response')} AS j
  FROM r a JOIN r b ON a.model_id = b.model_id AND a.prompt_id = b.prompt_id AND a.idx < b.idx),
means AS (SELECT model_id, prompt_id, avg(j) AS j FROM pairs GROUP BY ALL),
counts AS (SELECT model_id, prompt_id, count(*) AS responses FROM r GROUP BY ALL)
SELECT model_id, prompt_id, responses, coalesce(j, 1.0) AS consistency FROM counts LEFT JOIN means USING (model_id, prompt_id)"""

_LETTERS = "CASE {v} WHEN 4 THEN 'A' WHEN 2 THEN 'C' ELSE 'F' END"


def _verdict(relation: str) -> str:
    """Overall grade and summary over rows with benchmark_grade, hallucination_rate, improvement_pct."""
    points = "CASE benchmark_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END"
    truthful = "CASE WHEN hallucination_rate < 0.05 THEN 4 WHEN hallucination_rate < 0.15 THEN 2 ELSE 0 END"
    better = "CASE WHEN improvement_pct IS NULL THEN 3 WHEN improvement_pct >= 20 THEN 4 WHEN improvement_pct >= 5 THEN 2 ELSE 0 END"
    return f"""
SELECT *, 'Overall grade: ' || overall_grade || '. Benchmark grade: ' || benchmark_grade || '. Hallucination rate: '
  || printf('%.2f', hallucination_rate * 100) || '%. '
  || CASE WHEN improvement_pct IS NULL THEN '{verdicts.NO_BASELINE}'
     ELSE 'Improvement over baseline: ' || CASE WHEN isinf(improvement_pct) THEN 'inf' ELSE printf('%.1f', improvement_pct) END || '%.' END
  || ' ' || CASE WHEN overall_grade IN ('A', 'B') THEN '{verdicts.PRODUCTION}' WHEN overall_grade = 'C' THEN '{verdicts.NEEDS_WORK}'
     ELSE '{verdicts.REJECTED}' END AS summary
FROM (SELECT *, CASE WHEN s >= 3.5 THEN 'A' WHEN s >= 2.5 THEN 'B' WHEN s >= 1.5 THEN 'C' WHEN s >= 0.5 THEN 'D' ELSE 'F' END AS overall_grade
  FROM (SELECT *, ({points} + {truthful} + {better}) / 3.0 AS s FROM ({relation})))"""


_WINS = f"""
wins AS (
  SELECT model_id, count(*) AS samples, count(*) FILTER ({_same('prediction')} AND NOT {_same('baseline')}) AS wins,
    count(*) FILTER ({_same('baseline')} AND NOT {_same('prediction')}) AS losses,
    count(*) FILTER ({_same('prediction')} = {_same('baseline')}) AS ties,
    avg({_overlap('prediction', 'reference')}) AS faithfulness,
    avg(({_overlap('prediction', 'reference')} < 0.5)::INT) AS hallucination_rate FROM samples GROUP BY model_id)"""
_QA_REPORT = """
SELECT w.*, q.em AS exact_match, q.f1 AS f1, 'qa' AS task_type, (g1 + g2) / 2 AS improvement_pct,
  CASE WHEN least(p1, p2) = 4 THEN 'A' WHEN least(p1, p2) = 2 THEN 'C' ELSE 'F' END AS benchmark_grade
FROM wins w JOIN (SELECT q.model_id, q.em, q.f1, {g1} AS g1, {g2} AS g2,
    CASE WHEN q.em >= 0.8 THEN 4 WHEN q.em >= 0.6 THEN 2 ELSE 0 END AS p1,
    CASE WHEN q.f1 >= 0.75 THEN 4 WHEN q.f1 >= 0.5 THEN 2 ELSE 0 END AS p2
  FROM qa q JOIN base_qa b USING (model_id)) q USING (model_id)""".format(g1=_gain("q.em", "b.em"), g2=_gain("q.f1", "b.f1"))
_CLASS_REPORT = """
SELECT w.*, q.em AS exact_match, c.f1 AS f1, c.accuracy, c.precision, c.recall, 'classification' AS task_type,
  ({g}) / 4 AS improvement_pct, CASE WHEN c.f1 >= 0.75 THEN 'A' WHEN c.f1 >= 0.5 THEN 'C' ELSE 'F' END AS benchmark_grade
FROM wins w JOIN qa q USING (model_id) JOIN tuned c USING (model_id) JOIN base b USING (model_id)""".format(
    g=" + ".join(_gain(f"c.{n}", f"b.{n}") for n in ("accuracy", "precision", "recall", "f1"))
)
_WORDS = f"""
words AS (
  SELECT model_id, sample_id, prediction IS NULL OR reference IS NULL AS missing,
    coalesce({sql_tokens('prediction')}, []) AS p, coalesce({sql_tokens('reference')}, []) AS r FROM samples)"""


def _runs(side: str) -> str:
    run = f"array_to_string(list_slice({side}, i, i + n - 1), ' ')"
    return f"SELECT model_id, sample_id, n, unnest(list_transform(range(1, len({side}) - n + 2), lambda i: {run})) AS run FROM words, range(1, 5) o(n)"


_RUN_SUMS = f"""
given AS (SELECT model_id, sample_id, n, run, count(*) AS c FROM ({_runs('p')}) GROUP BY ALL),
wanted AS (SELECT model_id, sample_id, n, run, count(*) AS c FROM ({_runs('r')}) GROUP BY ALL),
shared AS (SELECT model_id, sample_id, n, sum(least(g.c, w.c)) AS c FROM given g JOIN wanted w USING (model_id, sample_id, n, run) GROUP BY ALL)"""
# A row of the table of common subsequences follows from the one before it: the running maximum of staying, or growing at an equal word.
_GROWN = "list_transform(range(1, len(p) + 1), lambda j: greatest(line[j + 1], line[j] + (p[j] = r[i])::INT))"
_SUBSEQUENCES = f"""
steps AS (
  SELECT model_id, sample_id, p, r, 0 AS i, list_transform(range(0, len(p) + 1), lambda j: 0) AS line FROM words UNION ALL
  SELECT model_id, sample_id, p, r, i, list_concat([0], list_transform(range(1, len(p) + 1), lambda j: list_max(list_slice(grown, 1, j)))) FROM (
    SELECT model_id, sample_id, p, r, i, {_GROWN} AS grown FROM (SELECT model_id, sample_id, p, r, i + 1 AS i, line FROM steps WHERE i < len(r)))),
longest AS (SELECT model_id, sample_id, line[-1] AS n FROM steps WHERE i = len(r))"""

QUERIES = {
    "sample_correctness": sample_correctness,
    "exact_match": exact_match,
    "qa_metrics": qa_metrics,
    "token_f1": token_f1,
    "bleu": bleu,
    "rouge_1": rouge_1,
    "rouge_l": rouge_l,
    "classification_metrics": classification_metrics,
    "task_types": task_types,
    "comparison_rows": comparison_rows,
    "win_loss": win_loss,
    "improvement": improvement,
    "faithfulness": faithfulness,
    "hallucination_flags": hallucination_flags,
    "alignment_report": alignment_report,
    "self_consistency": self_consistency,
    "divergent_prompts": divergent_prompts,
    "exact_consistency": exact_consistency,
    "consistency_check": consistency_check,
    "latency_stats": latency_stats,
    "latency_by_user": latency_by_user,
    "format_compliance": format_compliance,
    "responses_by_model": responses_by_model,
    "grade_models": grade_models,
    "validation_report": validation_report,
    "validation_report_classes": validation_report_classes,
}

ORACLE = {
    "sample_correctness": f"{_SAMPLES} SELECT model_id, sample_id, prediction, reference, {_same('prediction')} AS correct FROM samples",
    "exact_match": f"""{_SAMPLES}
SELECT model_id, round(avg({_same('prediction')}::INT), 6) AS exact_match, count(*) AS total_samples,
  count(*) FILTER ({_same('prediction')}) AS correct FROM samples GROUP BY model_id""",
    "qa_metrics": f"{_SAMPLES}, {_QA} SELECT model_id, round(em, 6) AS exact_match, round(f1, 6) AS f1 FROM qa",
    "bleu": f"""{_SAMPLES}, {_WORDS}, {_RUN_SUMS},
orders AS (SELECT model_id, n, sum(c) AS s FROM shared GROUP BY ALL),
runs AS (SELECT model_id, n, sum(greatest(len(p) - n + 1, 0)) AS t FROM words, range(1, 5) o(n) GROUP BY ALL),
logs AS (SELECT model_id, CASE WHEN count(s) = 4 THEN sum(ln(s / t)) / 4 END AS l FROM runs LEFT JOIN orders USING (model_id, n) GROUP BY model_id),
lengths AS (SELECT model_id, sum(len(p)) AS c, sum(len(r)) AS w FROM words GROUP BY model_id)
SELECT model_id, coalesce(round(exp(l + least(0, 1 - w / c)), 6), 0) AS bleu FROM logs JOIN lengths USING (model_id)""",
    "rouge_1": f"""{_SAMPLES}, {_WORDS}, {_RUN_SUMS}
SELECT model_id, round(avg(CASE WHEN missing THEN 0 WHEN len(p) + len(r) = 0 THEN 1 ELSE 2.0 * coalesce(c, 0) / (len(p) + len(r)) END::DOUBLE), 6) AS rouge_1
FROM words LEFT JOIN (SELECT * FROM shared WHERE n = 1) USING (model_id, sample_id) GROUP BY model_id""",
    "rouge_l": f"""{_SAMPLES.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_WORDS}, {_SUBSEQUENCES}
SELECT model_id, round(avg(CASE WHEN missing THEN 0 WHEN len(p) + len(r) = 0 THEN 1 ELSE 2.0 * n / (len(p) + len(r)) END::DOUBLE), 6) AS rouge_l
FROM words JOIN longest USING (model_id, sample_id) GROUP BY model_id""",
    "token_f1": f"{_SAMPLES}, {_f1('f1s', 'prediction')} SELECT model_id, sample_id, round(f1, 6) AS f1 FROM f1s",
    "classification_metrics": f"""{_LABELLED}, {_classes('m', 'prediction')}
SELECT model_id, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m""",
    "task_types": f"""
SELECT model_id, CASE WHEN avg(coalesce(length(reference), 0)) < 20 THEN 'classification' ELSE 'qa' END AS task_type,
  round(avg(coalesce(length(reference), 0)), 6) AS mean_length
FROM (SELECT model_id, reference FROM ({_SAMPLES} SELECT * FROM samples) UNION ALL SELECT model_id, reference FROM ({_LABELLED} SELECT * FROM samples))
GROUP BY model_id""",
    "comparison_rows": f"""{_SAMPLES}
SELECT model_id, sample_id, prompt, baseline, prediction, reference,
  CASE WHEN {_same('prediction')} AND NOT {_same('baseline')} THEN 'finetuned'
    WHEN {_same('baseline')} AND NOT {_same('prediction')} THEN 'baseline' ELSE 'tie' END AS winner FROM samples""",
    "win_loss": f"{_LABELLED}, {_WINS} SELECT model_id, wins, losses, ties FROM wins",
    "improvement": f"""{_SAMPLES}, {_QA}, {_BASE_QA}
SELECT model_id, 'exact_match' AS metric, {_gain('q.em', 'b.em')} AS improvement_pct FROM qa q JOIN base_qa b USING (model_id)
UNION ALL SELECT model_id, 'f1', {_gain('q.f1', 'b.f1')} FROM qa q JOIN base_qa b USING (model_id)""",
    "faithfulness": f"""{_SAMPLES}, scored AS (SELECT model_id, {_overlap('prediction', 'reference')} AS o FROM samples)
SELECT model_id, round(avg(o), 6) AS faithfulness, round(avg((o < 0.5)::INT), 6) AS hallucination_rate,
  count(*) FILTER (o < 0.5) AS flagged FROM scored GROUP BY model_id""",
    "hallucination_flags": f"""{_SAMPLES}
SELECT model_id, sample_id, {_places('o', 4)} AS overlap
FROM (SELECT model_id, sample_id, {_overlap('prediction', 'reference')} AS o FROM samples) WHERE o < 0.5""",
    "alignment_report": """
SELECT role AS model_id, count(*) AS predictions, count(*) FILTER (length(text) > 200) AS aligned,
  count(*) FILTER (length(text) <= 200) AS missing_references FROM conversations GROUP BY role""",
    "self_consistency": f"SELECT model_id, prompt_id, responses, round(consistency, 6) AS consistency FROM ({_SELF})",
    "divergent_prompts": f"""
SELECT model_id, prompt_id, responses, {_places('consistency', 4)} AS consistency FROM ({_SELF}) WHERE responses >= 2 AND consistency < 0.7""",
    "exact_consistency": f"""
SELECT model_id, prompt_id, responses, round(consistency, 6) AS consistency
FROM ({_exact_consistency(f"SELECT * REPLACE (' ' || (length(response) // 100) AS response) FROM ({_RESPONSES})")})""",
    "consistency_check": f"""
SELECT model_id, round(avg(consistency), 6) AS consistency, count(*) AS prompts,
  CASE WHEN avg(consistency) >= 0.85 THEN 'pass' WHEN avg(consistency) >= 0.7 THEN 'warning' ELSE 'fail' END AS "check"
FROM ({_exact_consistency(_RESPONSES)}) GROUP BY model_id""",
    "latency_stats": _latency("SELECT event_type AS model_id, value AS v FROM events"),
    "latency_by_user": f"SELECT * RENAME (model_id AS user_id) FROM ({_latency('SELECT user_id AS model_id, value AS v FROM events')})",
    "format_compliance": f"""
WITH outputs AS (SELECT 'json' AS expected_format, props AS output FROM events
  UNION ALL SELECT unnest([' List', 'text', 'JSON']), text FROM documents),
judged AS (SELECT expected_format, CASE {_norm('expected_format')} WHEN 'json' THEN json_valid(output)
    WHEN 'list' THEN contains({sql_strip('output')}, chr(10)) OR left({sql_strip('output')}, 1) IN ('-', '*')
    ELSE length({sql_strip('output')}) > 0 END AS ok FROM outputs)
SELECT expected_format, count(*) AS outputs, count(*) FILTER (ok) AS compliant,
  round(avg(coalesce(ok, false)::INT), 6) AS format_compliance FROM judged GROUP BY expected_format""",
    "responses_by_model": f"""{_SAMPLES}
SELECT sample_id AS prompt_id, {', '.join(f"max(prediction) FILTER (model_id = '{m}') AS {m}" for m in ('content_words', 'echo', 'padded', 'short_words'))}
FROM samples GROUP BY sample_id""",
    "grade_models": f"""
SELECT model_id, CASE WHEN least(p1, p2) = 4 THEN 'A' WHEN least(p1, p2) = 2 THEN 'C' ELSE 'F' END AS benchmark_grade
FROM (SELECT model_id, CASE WHEN em >= 0.8 THEN 4 WHEN em >= 0.6 THEN 2 ELSE 0 END AS p1,
    CASE WHEN f1 >= 0.75 THEN 4 WHEN f1 >= 0.5 THEN 2 ELSE 0 END AS p2 FROM ({_SAMPLES}, {_QA} SELECT * FROM qa))
UNION ALL SELECT model_id, CASE WHEN f1 >= 0.75 THEN 'A' WHEN f1 >= 0.5 THEN 'C' ELSE 'F' END
FROM ({_LABELLED}, {_classes('m', 'prediction')} SELECT * FROM m)
UNION ALL SELECT model_id || '_words', CASE WHEN f >= 0.8 THEN 'A' WHEN f >= 0.6 THEN 'B' WHEN f >= 0.4 THEN 'C' WHEN f >= 0.2 THEN 'D' ELSE 'F' END
FROM ({_SAMPLES} SELECT model_id, avg({_overlap('prediction', 'reference')}) AS f FROM samples GROUP BY model_id)""",
    "validation_report": f"""
{_SAMPLES}, {_QA}, {_BASE_QA}, {_WINS}
SELECT * EXCLUDE (s) REPLACE (round(exact_match, 6) AS exact_match, round(f1, 6) AS f1, round(faithfulness, 6) AS faithfulness,
  round(hallucination_rate, 6) AS hallucination_rate, round(improvement_pct, 6) AS improvement_pct) FROM ({_verdict(_QA_REPORT)})""",
    "validation_report_classes": f"""
{_LABELLED}, {_QA}, {_WINS}, {_classes('tuned', 'prediction')}, {_classes('base', 'baseline')},
agreed AS (SELECT model_id, avg(consistency) AS consistency FROM ({_exact_consistency(
    "SELECT model_id, reference AS prompt_id, prediction AS response FROM samples")}) GROUP BY model_id),
lat AS ({_latency("SELECT 'length_' || CASE WHEN user_id > 50 THEN 200 ELSE 1000 END AS model_id, value AS v FROM events")})
SELECT * EXCLUDE (s) REPLACE (round(exact_match, 6) AS exact_match, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(faithfulness, 6) AS faithfulness,
  round(hallucination_rate, 6) AS hallucination_rate, round(improvement_pct, 6) AS improvement_pct, round(consistency, 6) AS consistency),
  CASE WHEN consistency >= 0.85 THEN 'pass' WHEN consistency >= 0.7 THEN 'warning' ELSE 'fail' END AS consistency_check
FROM ({_verdict(_CLASS_REPORT)}) JOIN agreed USING (model_id) LEFT JOIN lat USING (model_id)""",
}
