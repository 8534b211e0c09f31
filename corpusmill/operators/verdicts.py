"""Grades, checks and the summary of a validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.answers import token_f1
from corpusmill.functions.numbers import fixed
from corpusmill.operators.metrics import (
    HALLUCINATION_BELOW,
    classification_metrics,
    compare_samples,
    improvement_pct,
    overlap,
    same_answer,
    task_types,
)

# Metric -> (pass, warning), grade points, and the cuts of mean scores.
THRESHOLDS = {
    "exact_match": (0.8, 0.6),
    "f1": (0.75, 0.5),
    "consistency": (0.85, 0.7),
    "hallucination_rate": (0.05, 0.15),
    "improvement_pct": (20.0, 5.0),
}
POINTS = {"A": 4, "B": 3, "C": 2, "D": 1, "F": 0}
OVERALL_CUTS = {"A": 3.5, "B": 2.5, "C": 1.5, "D": 0.5}
AVERAGE_CUTS = {"A": 0.8, "B": 0.6, "C": 0.4, "D": 0.2}
PRODUCTION = "Model is recommended for production deployment."
NEEDS_WORK = "Model may need further fine-tuning before production use."
REJECTED = "Model is not recommended for production deployment."
NO_BASELINE = "No baseline comparison performed."

MODEL = ("model_id",)


def _letter(score: Column, cuts: Mapping[str, float]) -> Column:
    grade = None
    for letter, cut in cuts.items():
        grade = F.when(score >= cut, letter) if grade is None else grade.when(score >= cut, letter)
    return grade.otherwise("F")


def _points(grade: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in POINTS.items() for x in p]), grade), F.lit(0))


def grade_metrics(
    metrics: DataFrame, *, by: Sequence[str] = MODEL, thresholds: Mapping[str, tuple[float, float]] = THRESHOLDS
) -> DataFrame:
    """Grade per model from (metric, value) rows: the worst metric with thresholds decides; without
    any, the mean value does."""
    points = F.lit(None).cast("int")
    for metric, (good, fair) in thresholds.items():
        value = F.col("value")
        points = F.when(F.col("metric") == metric, F.when(value >= good, 4).when(value >= fair, 2).otherwise(0)).otherwise(points)
    judged = metrics.groupBy(*by).agg(F.min(points).alias("_worst"), F.avg("value").alias("_mean"))
    worst = F.when(F.col("_worst") == 4, "A").when(F.col("_worst") == 2, "C").otherwise("F")
    grade = F.when(F.col("_worst").isNull(), _letter(F.col("_mean"), AVERAGE_CUTS)).otherwise(worst)
    return judged.select(*by, grade.alias("benchmark_grade"))


def consistency_check(score: Column, thresholds: tuple[float, float] = THRESHOLDS["consistency"]) -> Column:
    good, fair = thresholds
    return F.when(score >= good, "pass").when(score >= fair, "warning").otherwise("fail")


def overall_grade(benchmark_grade: Column, hallucination_rate: Column, improvement: Column) -> Column:
    """Mean of three scores; a missing comparison (null ``improvement``) counts 3."""
    few, some = THRESHOLDS["hallucination_rate"]
    strong, slight = THRESHOLDS["improvement_pct"]
    truthful = F.when(hallucination_rate < few, 4).when(hallucination_rate < some, 2).otherwise(0)
    better = F.when(improvement.isNull(), 3).when(improvement >= strong, 4).when(improvement >= slight, 2).otherwise(0)
    return _letter((_points(benchmark_grade) + truthful + better) / 3.0, OVERALL_CUTS)


def summary_text(grade: Column, benchmark_grade: Column, hallucination_rate: Column, improvement: Column) -> Column:
    advice = F.when(grade.isin("A", "B"), PRODUCTION).when(grade == "C", NEEDS_WORK).otherwise(REJECTED)
    compared = F.concat(F.lit("Improvement over baseline: "), fixed(improvement, 1), F.lit("%."))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Overall grade: "), grade, F.lit(".")),
        F.concat(F.lit("Benchmark grade: "), benchmark_grade, F.lit(".")),
        F.concat(F.lit("Hallucination rate: "), fixed(hallucination_rate * 100, 2), F.lit("%.")),
        F.when(improvement.isNull(), NO_BASELINE).otherwise(compared),
        advice,
    )


def _one_pass(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Everything that averages over samples, from a single grouping."""
    compared = "baseline" in samples.columns
    if compared:
        samples = compare_samples(samples)
    samples = samples.withColumn("_overlap", overlap("prediction", "reference"))
    shared = F.col("_overlap")
    columns = [
        F.avg(same_answer("prediction", "reference").cast("int")).alias("exact_match"),
        F.avg(token_f1("prediction", "reference")).alias("f1"),
        F.avg(shared).alias("faithfulness"),
        F.avg((shared < HALLUCINATION_BELOW).cast("int")).alias("hallucination_rate"),
        F.count(F.lit(1)).alias("samples"),
    ]
    if compared:
        columns += [
            F.avg(same_answer("baseline", "reference").cast("int")).alias("base_exact_match"),
            F.avg(token_f1("baseline", "reference")).alias("base_f1"),
            *[F.count_if(F.col("winner") == w).alias(n) for w, n in (("finetuned", "wins"), ("baseline", "losses"), ("tie", "ties"))],
        ]
    return samples.groupBy(*by).agg(*columns)


def validation_report(
    samples: DataFrame,
    *,
    by: Sequence[str] = MODEL,
    task_type: str | None = "qa",
    consistency: DataFrame | None = None,
    latency: DataFrame | None = None,
) -> DataFrame:
    """One row per model: metrics, comparison, checks, grades and summary.

    ``task_type`` None decides per model by the length of the references. ``consistency`` and
    ``latency`` are the results of their operators, one row per model.
    """
    report = _one_pass(samples, by)
    compared = "base_f1" in report.columns
    if task_type is None:
        report = report.join(task_types(samples, by=by).drop("mean_length"), list(by))
    else:
        report = report.withColumn("task_type", F.lit(task_type))
    qa_gain = [improvement_pct(F.col(m), F.col(f"base_{m}")) for m in ("exact_match", "f1")] if compared else []
    qa_mean = sum(qa_gain[1:], qa_gain[0]) / len(qa_gain) if compared else F.lit(None).cast("double")
    qa_points = F.least(_threshold_points("exact_match"), _threshold_points("f1"))

    if task_type == "qa":
        report = report.withColumn("improvement_pct", qa_mean).withColumn("_points", qa_points)
    else:
        names = ("accuracy", "precision", "recall", "f1")
        labels = classification_metrics(samples, by=by).withColumnsRenamed({n: f"_class_{n}" for n in names})
        report = report.join(labels, list(by))
        class_mean = F.lit(None).cast("double")
        if compared:
            base = classification_metrics(samples, by=by, prediction="baseline")
            report = report.join(base.withColumnsRenamed({n: f"_base_{n}" for n in names}), list(by))
            gains = [improvement_pct(F.col(f"_class_{n}"), F.col(f"_base_{n}")) for n in names]
            class_mean = sum(gains[1:], gains[0]) / len(gains)
        is_class = F.col("task_type") == "classification"
        report = report.withColumns(
            {
                "improvement_pct": F.when(is_class, class_mean).otherwise(qa_mean),
                "_points": F.when(is_class, _threshold_points("f1", "_class_f1")).otherwise(qa_points),
                "f1": F.when(is_class, F.col("_class_f1")).otherwise(F.col("f1")),
                **{n: F.when(is_class, F.col(f"_class_{n}")) for n in names if n != "f1"},
            }
        ).drop(*[f"_{side}_{n}" for side in ("class", "base") for n in names])

    grade = F.when(F.col("_points") == 4, "A").when(F.col("_points") == 2, "C").otherwise("F")
    report = report.withColumn("benchmark_grade", grade).drop("_points", "base_exact_match", "base_f1")
    if consistency is not None:
        report = report.join(consistency.select(*by, "consistency"), list(by), "left").withColumn(
            "consistency", F.coalesce("consistency", F.lit(1.0))
        )
        report = report.withColumn("consistency_check", consistency_check(F.col("consistency")))
    if latency is not None:
        report = report.join(latency, list(by), "left")
    verdict = [F.col("benchmark_grade"), F.col("hallucination_rate"), F.col("improvement_pct")]
    report = report.withColumn("overall_grade", overall_grade(*verdict))
    return report.withColumn("summary", summary_text(F.col("overall_grade"), *verdict))


def _threshold_points(metric: str, column: str | None = None) -> Column:
    good, fair = THRESHOLDS[metric]
    value = F.col(column or metric)
    return F.when(value >= good, 4).when(value >= fair, 2).otherwise(0)
