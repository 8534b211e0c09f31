"""Pattern entities with their place in the text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, pattern, and literals of which every match holds one.
PATTERNS = {
    "EMAIL": (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", ["@"]),
    "DATE": (r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", ["-", "/"]),
    "MONEY": (r"\$[\d,]+\.?\d*", ["$"]),
    "URL": (r"https?://[^\s]+", ["http"]),
    "PHONE": (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", []),
}

ENTITY_TYPE = "array<struct<label:string,text:string,start:int,end:int,confidence:double>>"


def _pattern_table(extra: Mapping[str, str] | None) -> dict[str, tuple[str, list[str]]]:
    table = dict(PATTERNS)
    for label, pattern in (extra or {}).items():
        table[label] = (pattern, [])
    return table


def _unicode(pattern: str) -> str:
    """Digits, spaces and word ends by Unicode rules."""
    return f"(?U){pattern}"


def _possible(text: Column, literals: list[str]) -> Column:
    """Whether a text can hold a match at all; a plain search that spares most texts the pattern."""
    if not literals:
        return F.lit(True)
    return reduce(Column.__or__, [F.contains(text, F.lit(literal)) for literal in literals])


def _located(text: Column, label: str, pattern: str) -> Column:
    """Matches of one label. The text between matches gives the offsets: a match starts after all
    gaps and matches before it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        matches,
        F.slice(gaps, 1, F.size(matches)),
        lambda match, gap: F.struct(match.alias("text"), F.length(gap).alias("gap"), F.length(match).alias("size")),
    )

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        found = F.struct(
            F.lit(label).alias("label"),
            step["text"].alias("text"),
            begin.alias("start"),
            (begin + step["size"]).alias("end"),
            F.lit(1.0).alias("confidence"),
        )
        return F.struct((begin + step["size"]).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(ENTITY_TYPE).alias("found"))
    return F.aggregate(steps, start, add, lambda state: state["found"])


def entities_of(text: Column, extra_patterns: Mapping[str, str] | None = None) -> Column:
    """All non-overlapping matches, label by label in the order of the pattern table."""
    nothing = F.array().cast(ENTITY_TYPE)
    per_label = []
    for label, (pattern, literals) in _pattern_table(extra_patterns).items():
        pattern = _unicode(pattern)
        per_label.append(F.when(_possible(text, literals) & F.rlike(text, F.lit(pattern)), _located(text, label, pattern)).otherwise(nothing))
    return F.concat(*per_label)


def extract_entities(
    df: DataFrame, *, content: str = "content", extra_patterns: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per match next to the other columns of ``df``."""
    carried = [c for c in df.columns if c != content]
    return df.select(*carried, F.inline(entities_of(F.col(content), extra_patterns)))


def count_entities(df: DataFrame, *, by: tuple[str, ...] = (), content: str = "content") -> DataFrame:
    """Matches per label, without building the matches."""
    text = F.col(content)
    per_label = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.when(_possible(text, literals), F.regexp_count(text, F.lit(_unicode(pattern)))).otherwise(0).alias("n"),
            )
            for label, (pattern, literals) in PATTERNS.items()
        ]
    )
    return df.select(*by, F.inline(per_label)).groupBy(*by, "label").agg(F.sum("n").alias("entities"))
