"""Cleaning steps, in the order in which they apply, and their report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bound, strip
from corpusmill.operators.dedup import drop_exact_duplicates, first_copies

# Broken byte sequences and what they stand for; applied in this order.
MOJIBAKE = (
    ("â\x80\x99", "’"),
    ("â\x80\x9c", "“"),
    ("â\x80\x9d", "”"),
    ("â\x80\x93", "–"),
    ("â\x80\x94", "—"),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ã¯", "ï"),
    ("Ã¢", "â"),
)


@dataclass(frozen=True)
class CleanOptions:
    dedup: bool = True
    fix_encoding: bool = True
    strip_html: bool = True
    normalize_whitespace: bool = True
    collapse_newlines: bool = True
    remove_empty: bool = True
    min_content_length: int = 10
    max_content_length: int | None = None
    custom_filters: Sequence[Column | Callable[[DataFrame], Column]] = field(default_factory=tuple)


def _where(condition: Callable[[Column], Column], change: Callable[[Column], Column], text: Column) -> Column:
    """Change the texts that meet a cheap condition; the others skip the costly part."""
    return bound(text, lambda t: F.when(condition(t), change(t)).otherwise(t))


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda t: reduce(Column.__or__, [F.contains(t, F.lit(part)) for part in parts])


def fix_encoding(text: Column) -> Column:
    def repair(broken_text: Column) -> Column:
        return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, broken_text)

    return _where(_holds("â", "Ã"), repair, text)


def strip_html(text: Column) -> Column:
    return _where(_holds("<"), lambda t: F.regexp_replace(t, "<[^>]+>", ""), text)


def normalize_whitespace(text: Column, collapse_newlines: bool = True) -> Column:
    """Blank runs become one space, newline runs one newline. Texts without a double blank or a tab
    need no pattern for that."""
    text = _where(_holds("  ", "\t"), lambda t: F.regexp_replace(t, r"[ \t]{2,}|\t", " "), text)
    if collapse_newlines:
        text = _where(_holds("\n\n"), lambda t: F.regexp_replace(t, r"\n{2,}", "\n"), text)
    return strip(text)


def cleaned_text(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    text = F.coalesce(text, F.lit(""))
    if options.fix_encoding:
        text = fix_encoding(text)
    if options.strip_html:
        text = strip_html(text)
    if options.normalize_whitespace:
        text = normalize_whitespace(text, options.collapse_newlines)
    return text


def rejected_by(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Name of the first length rule that a cleaned text fails, else null."""
    reason = F.lit(None).cast("string")
    size = F.length(text)
    if options.max_content_length is not None:
        reason = F.when(size > options.max_content_length, "long").otherwise(reason)
    reason = F.when(size < options.min_content_length, "short").otherwise(reason)
    if options.remove_empty:
        reason = F.when(F.length(strip(text)) == 0, "empty").otherwise(reason)
    return reason


def with_cleaned(df: DataFrame, options: CleanOptions = CleanOptions(), *, content: str = "content") -> DataFrame:
    """Replace ``content`` by its cleaned form. Exploding a one-element array makes the text a real
    column: filters on it read that column and do not repeat the cleaning."""
    others = [c for c in df.columns if c != content]
    return df.select(*others, F.explode(F.array(cleaned_text(F.col(content), options))).alias(content))


def _predicates(df: DataFrame, options: CleanOptions) -> list[Column]:
    return [rule(df) if not isinstance(rule, Column) else rule for rule in options.custom_filters]


def clean(
    df: DataFrame,
    options: CleanOptions = CleanOptions(),
    *,
    content: str = "content",
    order_by: Sequence[str] = ("doc_id",),
    corpus: Sequence[str] = (),
) -> DataFrame:
    """The documents that survive, with cleaned content. Of equal texts the first by ``order_by`` stays."""
    kept = with_cleaned(df, options, content=content)
    kept = kept.where(rejected_by(F.col(content), options).isNull())
    if options.dedup:
        kept = drop_exact_duplicates(kept, content=content, order_by=order_by, within=corpus)
    for predicate in _predicates(kept, options):
        kept = kept.where(predicate)
    return kept


def clean_audit(
    df: DataFrame,
    options: CleanOptions = CleanOptions(),
    *,
    content: str = "content",
    order_by: Sequence[str] = ("doc_id",),
    corpus: Sequence[str] = (),
) -> DataFrame:
    """Every input document with ``encoding_fixed`` and the step that removed it (``removed_by``).

    ``order_by`` has to identify a row: it is the key on which first copies are looked up.
    """
    raw = F.coalesce(F.col(content), F.lit(""))
    fixed = (fix_encoding(raw) != raw) if options.fix_encoding else F.lit(False)
    rows = with_cleaned(df.withColumn("encoding_fixed", fixed), options, content=content)
    rows = rows.withColumn("removed_by", rejected_by(F.col(content), options))
    if options.dedup:
        passed = rows.where(F.col("removed_by").isNull())
        firsts = first_copies(passed, content=content, order_by=order_by, within=corpus)
        rows = rows.join(firsts.withColumn("_first", F.lit(True)), list(order_by), "left")
        repeated = F.col("removed_by").isNull() & F.col("_first").isNull()
        rows = rows.withColumn("removed_by", F.when(repeated, "duplicate").otherwise(F.col("removed_by")))
        rows = rows.drop("_first")
    for predicate in _predicates(rows, options):
        failed = F.col("removed_by").isNull() & ~F.coalesce(predicate, F.lit(False))
        rows = rows.withColumn("removed_by", F.when(failed, "custom").otherwise(F.col("removed_by")))
    return rows


def clean_report(
    df: DataFrame,
    options: CleanOptions = CleanOptions(),
    *,
    content: str = "content",
    order_by: Sequence[str] = ("doc_id",),
    corpus: Sequence[str] = (),
) -> DataFrame:
    """One row per corpus with the counters of each step.

    Without custom filters a single pass suffices: copies are counted, not located.
    """
    counters = [
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(F.col("encoding_fixed")).alias("encoding_fixes"),
        F.count_if(F.col("removed_by") == "empty").alias("removed_empty"),
        F.count_if(F.col("removed_by") == "short").alias("removed_short"),
        F.count_if(F.col("removed_by") == "long").alias("removed_long"),
    ]
    if options.custom_filters or not options.dedup:
        rows = clean_audit(df, options, content=content, order_by=order_by, corpus=corpus)
        report = rows.groupBy(*corpus).agg(
            *counters,
            F.count_if(F.col("removed_by") == "duplicate").alias("dedup_count"),
            F.count_if(F.col("removed_by").isNull()).alias("final_count"),
        )
    else:
        raw = F.coalesce(F.col(content), F.lit(""))
        fixed = (fix_encoding(raw) != raw) if options.fix_encoding else F.lit(False)
        slim = df.select(*corpus, fixed.alias("encoding_fixed"), F.col(content).alias("_text"))
        rows = with_cleaned(slim, options, content="_text").withColumn("removed_by", rejected_by(F.col("_text"), options))
        digest = F.when(F.col("removed_by").isNull(), F.md5(F.col("_text")))
        report = (
            rows.withColumn("_digest", digest)
            .groupBy(*corpus)
            .agg(
                *counters,
                F.count("_digest").alias("_passed"),
                F.count_distinct("_digest").alias("final_count"),
            )
            .withColumn("dedup_count", F.col("_passed") - F.col("final_count"))
            .drop("_passed")
        )
    return report.withColumn("removed_count", F.col("original_count") - F.col("final_count"))
