"""Check a column mapping against rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.numbers import fixed


def _problems(rows: DataFrame, mapping: Mapping[str, str]) -> list[Column]:
    """One struct per mapped column, null where the row is fine."""
    available = "[" + ", ".join(f"'{c}'" for c in rows.columns) + "]"
    found = []
    for source in mapping:
        if source not in rows.columns:  # fixed values: the wording of both findings
            hint = f"Column '{source}' not found in record. Available: {available}"
            found.append(F.struct(F.lit(source).alias("field"), F.lit("missing_column").alias("error_type"), F.lit(hint).alias("suggestion")))
            continue
        hint = f"Column '{source}' has null value. Consider filtering or providing a default."
        problem = F.struct(F.lit(source).alias("field"), F.lit("null_value").alias("error_type"), F.lit(hint).alias("suggestion"))
        found.append(F.when(F.col(source).isNull(), problem))
    return found


def mapping_errors(rows: DataFrame, mapping: Mapping[str, str], *, keep: Sequence[str]) -> DataFrame:
    """One row per record and mapped column that is missing or null; ``keep`` identifies the record."""
    problems = F.array_compact(F.array(*_problems(rows, mapping)))
    return rows.select(*keep, F.inline(problems))


def mapping_report(rows: DataFrame, mapping: Mapping[str, str], *, by: Sequence[str] = ()) -> DataFrame:
    """Coverage and approval of the mapping, per ``by`` value."""
    bad = F.lit(False)
    for problem in _problems(rows, mapping):
        bad = bad | problem.isNotNull()
    counts = rows.select(*by, bad.alias("_bad")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if("_bad").alias("invalid_records")
    )
    total, invalid = F.col("total_records"), F.col("invalid_records")
    coverage = F.when(total > 0, (total - invalid) / F.greatest(total, F.lit(1)) * 100.0).otherwise(0.0)
    report = counts.withColumn("valid_records", total - invalid).withColumn("coverage_pct", coverage)
    pct = F.col("coverage_pct")
    shown = fixed(pct, 1)
    warning = (
        F.when(pct == 100.0, F.lit(None).cast("string"))
        .when(
            pct >= 99.0,
            F.format_string(
                "Coverage is %s%% — auto-approved with notification. %d record(s) have issues.", shown, invalid
            ),
        )
        .when(
            pct >= 95.0,
            F.format_string("Coverage is %s%% — needs explicit approval. %d record(s) have issues.", shown, invalid),
        )
        .otherwise(F.format_string("Coverage is %s%% — blocked. Too many invalid records (%d/%d).", shown, invalid, total))
    )
    return report.withColumn("approved", pct >= 99.0).withColumn("warning", warning)
