"""Scores of model outputs.

Rows carry model_id, sample_id, prediction and reference, where needed also prompt and baseline.
Every result is grouped by model, so one job scores many models.

One rule holds for every score: a sample whose prediction or reference is missing (null) counts in the denominator and
scores 0. It is never correct, overlaps with nothing, and a missing side is never a class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.answers import is_json, token_f1
from corpusmill.functions.numbers import round_half_even
from corpusmill.functions.overlaps import ORDERS, shared_runs
from corpusmill.functions.text import normalized, strip, tokens, word_overlap

HALLUCINATION_BELOW = 0.5
CLASSIFICATION_BELOW = 20
MODEL = ("model_id",)


def same_answer(left: str, right: str) -> Column:
    """Whether both texts are there and equal."""
    return F.coalesce(normalized(F.col(left)) == normalized(F.col(right)), F.lit(False))


def overlap(left: str, right: str) -> Column:
    """Jaccard similarity of the two word sets; 0 when a side is missing."""
    missing = F.col(left).isNull() | F.col(right).isNull()
    return F.when(missing, F.lit(0.0)).otherwise(word_overlap(F.col(left), F.col(right)))


def align(predictions: DataFrame, references: DataFrame, *, on: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Predictions with their references by key; ``has_reference`` marks those without one."""
    marked = references.withColumn("has_reference", F.lit(True))
    joined = predictions.join(marked, list(on), "left")
    return joined.withColumn("has_reference", F.coalesce("has_reference", F.lit(False)))


def alignment_report(aligned: DataFrame, *, by: Sequence[str] = MODEL) -> DataFrame:
    return aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if("has_reference").alias("aligned"),
        F.count_if(~F.col("has_reference")).alias("missing_references"),
    )


def correctness(samples: DataFrame) -> DataFrame:
    return samples.withColumn("correct", same_answer("prediction", "reference"))


def exact_match(samples: DataFrame, *, by: Sequence[str] = MODEL) -> DataFrame:
    hit = same_answer("prediction", "reference").cast("int")
    return samples.groupBy(*by).agg(
        F.avg(hit).alias("exact_match"), F.count(F.lit(1)).alias("total_samples"), F.sum(hit).alias("correct")
    )


def qa_metrics(samples: DataFrame, *, by: Sequence[str] = MODEL, prediction: str = "prediction") -> DataFrame:
    return samples.groupBy(*by).agg(
        F.avg(same_answer(prediction, "reference").cast("int")).alias("exact_match"),
        F.avg(token_f1(prediction, "reference")).alias("f1"),
    )


def generation_metrics(samples: DataFrame, *, by: Sequence[str] = MODEL, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """BLEU of all samples together, and the means of ROUGE-1 and ROUGE-L.

    BLEU: the geometric mean of the shares of predicted word runs (of one to four words) that the references hold, each run as often as there,
    times the brevity penalty; 0 when an order has no match. ROUGE: F1 of shared words, and of the longest common subsequence; two texts
    without words score 1, a missing side scores 0, and its words count in BLEU's denominators.
    """
    n_words = lambda name: F.coalesce(F.size(tokens(F.col(name))), F.lit(0))
    scored = samples.withColumns({"_runs": shared_runs(prediction, reference), "_given": n_words(prediction), "_wanted": n_words(reference)})
    both = F.col("_given") + F.col("_wanted")
    missing = F.col(prediction).isNull() | F.col(reference).isNull()
    f1 = lambda name: F.when(missing, 0.0).when(both == 0, 1.0).otherwise(F.try_divide(2 * F.col(f"_runs.{name}"), both))
    orders = range(1, ORDERS + 1)
    sums = scored.groupBy(*by).agg(
        F.sum("_given").alias("_given"),
        F.sum("_wanted").alias("_wanted"),
        *[F.sum(f"_runs.shared_{n}").alias(f"_shared_{n}") for n in orders],
        *[F.sum(F.greatest(F.col("_given") - (n - 1), F.lit(0))).alias(f"_runs_{n}") for n in orders],
        F.avg(f1("shared_1")).alias("rouge_1"),
        F.avg(f1("subsequence")).alias("rouge_l"),
    )
    logs = sum((F.log(F.col(f"_shared_{n}") / F.nullif(f"_runs_{n}", F.lit(0))) for n in orders), F.lit(0.0)) / ORDERS
    brevity = F.least(F.lit(0.0), 1 - F.col("_wanted") / F.nullif("_given", F.lit(0)))
    matched = F.least(*[F.col(f"_shared_{n}") for n in orders]) > 0
    return sums.select(*by, F.when(matched, F.exp(logs + brevity)).otherwise(0.0).alias("bleu"), "rouge_1", "rouge_l")


def classification_metrics(samples: DataFrame, *, by: Sequence[str] = MODEL, prediction: str = "prediction") -> DataFrame:
    """Accuracy over all samples and macro scores over the reference labels. F1 is taken from the two macro scores."""
    given, wanted = normalized(F.col(prediction)), normalized(F.col("reference"))
    hit = F.coalesce(given == wanted, F.lit(False)).cast("int")
    sides = samples.select(
        *by,
        F.inline(
            F.array(
                F.struct(wanted.alias("label"), F.lit(1).alias("support"), F.lit(0).alias("claimed"), hit.alias("hit")),
                F.struct(given.alias("label"), F.lit(0).alias("support"), F.lit(1).alias("claimed"), F.lit(0).alias("hit")),
            )
        ),
    )
    labels = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit")
    )
    per_label = labels.where(F.col("support") > 0).select(
        *by,
        "support",
        "hit",
        F.when(F.col("claimed") > 0, F.try_divide("hit", "claimed")).otherwise(0.0).alias("precision"),
        (F.col("hit") / F.col("support")).alias("recall"),
        F.col("label").isNotNull().alias("is_label"),
    )
    labelled = lambda name: F.coalesce(F.avg(F.when(F.col("is_label"), F.col(name))), F.lit(0.0)).alias(name)
    macro = per_label.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        labelled("precision"),
        labelled("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return macro.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def task_types(samples: DataFrame, *, by: Sequence[str] = MODEL, response: str = "reference") -> DataFrame:
    """Short answers make a classification task."""
    mean = F.avg(F.length(F.coalesce(F.col(response), F.lit(""))))
    kind = F.when(mean < CLASSIFICATION_BELOW, "classification").otherwise("qa")
    return samples.groupBy(*by).agg(kind.alias("task_type"), mean.alias("mean_length"))


def compare_samples(samples: DataFrame) -> DataFrame:
    """Who answered better, the fine-tuned model (``prediction``) or the ``baseline``."""
    tuned, base = same_answer("prediction", "reference"), same_answer("baseline", "reference")
    winner = F.when(tuned & ~base, "finetuned").when(base & ~tuned, "baseline").otherwise("tie")
    return samples.withColumn("winner", winner)


def win_loss(samples: DataFrame, *, by: Sequence[str] = MODEL) -> DataFrame:
    return (
        compare_samples(samples)
        .groupBy(*by)
        .agg(
            F.count_if(F.col("winner") == "finetuned").alias("wins"),
            F.count_if(F.col("winner") == "baseline").alias("losses"),
            F.count_if(F.col("winner") == "tie").alias("ties"),
        )
    )


def long_metrics(metrics: DataFrame, names: Sequence[str], *, by: Sequence[str] = MODEL) -> DataFrame:
    """Metric columns as (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*by, F.inline(pairs))


def improvement_pct(tuned: Column, base: Column) -> Column:
    change = round_half_even(F.try_divide(tuned - base, base) * 100.0, 2)
    from_zero = F.when(tuned > 0, F.lit(float("inf"))).otherwise(0.0)
    return F.when(base == 0, from_zero).otherwise(change)


def improvement(tuned: DataFrame, base: DataFrame, *, by: Sequence[str] = MODEL) -> DataFrame:
    """Change per metric in percent; metrics that the baseline lacks are left out."""
    reference = base.withColumnRenamed("value", "_base")
    return tuned.join(reference, [*by, "metric"]).select(
        *by, "metric", improvement_pct(F.col("value"), F.col("_base")).alias("improvement_pct")
    )


def faithfulness(samples: DataFrame, *, by: Sequence[str] = MODEL, below: float = HALLUCINATION_BELOW) -> DataFrame:
    """Mean word overlap with the reference, and the share of samples under ``below``."""
    scored = samples.select(*by, overlap("prediction", "reference").alias("_overlap"))
    return scored.groupBy(*by).agg(
        F.avg("_overlap").alias("faithfulness"),
        F.avg((F.col("_overlap") < below).cast("int")).alias("hallucination_rate"),
        F.count_if(F.col("_overlap") < below).alias("flagged"),
    )


def hallucinations(samples: DataFrame, *, below: float = HALLUCINATION_BELOW) -> DataFrame:
    """The samples under ``below`` with their overlap."""
    # The array keeps the overlap from being computed again in the filter.
    scored = samples.select("*", F.explode(F.array(overlap("prediction", "reference"))).alias("overlap"))
    return scored.where(F.col("overlap") < below).withColumn("overlap", round_half_even(F.col("overlap"), 4))


def complies(expected_format: Column, output: Column) -> Column:
    kind, text = normalized(expected_format), strip(output)
    listed = F.contains(text, F.lit("\n")) | F.startswith(text, F.lit("-")) | F.startswith(text, F.lit("*"))
    return (
        F.when(kind == "json", is_json(F.when(kind == "json", output)))
        .when(kind == "list", listed)
        .otherwise(F.length(text) > 0)
    )


def format_compliance(
    outputs: DataFrame, *, by: Sequence[str] = MODEL, expected_format: str = "expected_format", output: str = "output"
) -> DataFrame:
    """Share of outputs that have the format they should."""
    judged = outputs.select(*by, complies(F.col(expected_format), F.col(output)).alias("_ok"))
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("outputs"),
        F.count_if("_ok").alias("compliant"),
        F.avg(F.coalesce("_ok", F.lit(False)).cast("int")).alias("format_compliance"),
    )


def responses_by_model(
    responses: DataFrame, models: Sequence[str], *, prompt: str = "prompt_id", model: str = "model_id", response: str = "response", order: str | None = None
) -> DataFrame:
    """One row per prompt with a column per model: its first response by ``order``, or without one the least text."""
    rank = F.when(F.col(response).isNotNull(), F.struct(*[F.col(c) for c in (order, response) if c]))
    return responses.groupBy(prompt).pivot(model, list(models)).agg(F.min_by(response, rank))
