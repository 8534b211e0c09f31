"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Unigrams and bigrams of words are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted, one from
trusted target documents and one from every document; a document's score is the mean log ratio of its n-grams. All
of it is DataFrame functions: words and n-grams stay in arrays of the row, the counts are one aggregation that map tasks
combine to ``BUCKETS`` rows each, and the weights come back as a broadcast table of ``BUCKETS`` rows at most.

Weights are whole numbers (``SCALE`` steps per nat), so a score does not depend on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAKS = r"[\x20\x09-\x0D]+"
BREAK_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

BUCKETS = 1 << 14
SMOOTHING = 10.0
SCALE = 1_000_000
MIN_SCORE = -0.1
#: The most trusted documents that the target multinomial is fitted on; ids are chosen by their hash.
TARGET_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than ASCII white space. Null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAK_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAKS))


def _after(values: str, k: int) -> Column:
    """The array without its first ``k`` values."""
    return F.slice(F.col(values), k + 1, F.greatest(F.size(values), F.lit(1)))


def _with_grams(rows: DataFrame) -> DataFrame:
    """Adds ``_uni`` and ``_bi`` to rows with ``_tokens``: hashes of each word, and of each word with the next.

    The last word is paired with the end of the text. Zipping hash arrays is several times faster than looking neighbours up.
    """
    rows = rows.withColumn("_uni", F.transform("_tokens", lambda w: F.xxhash64(w)))
    return rows.withColumn("_bi", F.zip_with("_uni", _after("_uni", 1), lambda a, b: F.xxhash64(a, b)))


def _bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def base_measures(rows: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to ``rows``; keeps ``_uni`` and ``_bi``."""
    value = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(BREAK_CHARS)) != "")
    staged = rows.withColumn("_tokens", words(F.col(text))).withColumn("_lines", worded)
    staged = _with_grams(staged)
    staged = staged.withColumn("_four", F.zip_with("_bi", _after("_bi", 2), lambda a, b: F.xxhash64(a, b)))
    five = F.zip_with("_four", _after("_uni", 4), lambda a, b: F.xxhash64(a, b))
    staged = staged.withColumn("_windows", F.slice(five, 1, F.greatest(F.size("_uni") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    order = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = staged.withColumn("_order", F.when(repeats, order))
    entries = F.col("_order")
    hash_at = lambda k: F.get(entries, k)["h"]
    twice = F.filter(entries, lambda e, k: e["h"].eqNullSafe(hash_at(k - 1)) | e["h"].eqNullSafe(hash_at(k + 1)))
    staged = staged.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    at = F.col("_at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))).cast("long"))
    n_words, n_repeat = F.size("_tokens").cast("long"), F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    staged = staged.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("_tokens", "")).cast("long"),
            "n_symbols": F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": n_repeat,
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return staged.withColumn("base_failed", failed).drop("_tokens", "_four", "_lines", "_windows", "_order", "_at")


def trusted_ids(labels: DataFrame, limit: int = TARGET_ROWS) -> DataFrame:
    """Ids of documents that every label calls good and none calls toxic; about ``limit`` of them at most, by hash."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = known.where("q = 1 AND coalesce(t, 0) = 0").select("doc_id")
    steps = 1 << 20
    share = min(1.0, limit / max(1, good.count()))
    return good if share == 1.0 else good.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(steps)) < int(share * steps))


def bucket_weights(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket`` and ``weight``: the scaled log ratio of every bucket that occurs, target against raw, from all documents."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("_tokens"))
    rows = _with_grams(rows.join(F.broadcast(trusted_ids(labels).withColumn("target", F.lit(1))), "doc_id", "left"))
    counts = (
        rows.select(F.coalesce("target", F.lit(0)).cast("long").alias("target"), F.explode(F.concat("_uni", "_bi")).alias("gram"))
        .select("target", _bucket(F.col("gram")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    )
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    expected = F.col("raw") * (F.col("all_target") / F.col("all_raw"))
    ratio = F.log((F.col("target") + SMOOTHING) / (expected + SMOOTHING))
    return counts.join(F.broadcast(totals)).select("bucket", F.round(ratio * SCALE).cast("long").alias("weight"))


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, score (mean log ratio of its n-grams) and kept.

    Only doc_id and text are read, so other columns may have any name. Null texts count as empty: no words, score 0,
    rejected by the base rule. Rows without doc_id are judged like others but are never trusted. Repeated rows are judged each
    by itself. Empty tables give an empty result; without trusted documents every ratio is 0 and only the base rule decides.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    rows = base_measures(rows, "_text").withColumn("_row", F.monotonically_increasing_id())
    weights = F.broadcast(bucket_weights(docs, labels, doc_id=doc_id, text=text))  # BUCKETS rows at most
    keys = ["_row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scored = (
        rows.select(*keys, F.explode_outer(F.concat("_uni", "_bi")).alias("gram"))
        .withColumn("bucket", _bucket(F.col("gram")))
        .join(weights, "bucket", "left")
        .groupBy(*keys)
        .agg(F.sum("weight").alias("total"), F.count("gram").alias("n_grams"))
    )
    score = F.coalesce(F.col("total") / F.nullif("n_grams", F.lit(0)), F.lit(0.0)) / SCALE
    scored = scored.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= MIN_SCORE))
    return scored.drop("_row", "total", "n_grams")
