"""Cleaning, exact duplicates and corpus quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.operators import clean as cl
from corpusmill.operators.dedup import drop_exact_duplicates, drop_known
from corpusmill.operators.near_duplicates import drop_near_duplicates
from corpusmill.operators.quality import score_quality
from corpusmill.plans.common import documents, rounded, sql_strip, sql_tokens, table

CAPPED = cl.CleanOptions(max_content_length=20_000)


def sql_fix_encoding(expr: str) -> str:
    for broken, good in cl.MOJIBAKE:
        code = " || ".join(f"chr({ord(ch)})" for ch in broken)
        expr = f"replace({expr}, {code}, '{good}')"
    return expr


def sql_strip_html(expr: str) -> str:
    return f"regexp_replace({expr}, '<[^>]+>', '', 'g')"


def sql_whitespace(expr: str) -> str:
    spaced = f"regexp_replace({expr}, '[ \\t]+', ' ', 'g')"
    return sql_strip(f"regexp_replace({spaced}, '\\n{{2,}}', chr(10), 'g')")


def sql_cleaned(expr: str) -> str:
    return sql_whitespace(sql_strip_html(sql_fix_encoding(expr)))


_CLEANED = f"SELECT *, {sql_cleaned('text')} AS content FROM documents"
_STEP = f"""CASE WHEN length({sql_strip('content')}) = 0 THEN 'empty' WHEN length(content) < 10 THEN 'short'
  WHEN length(content) > 20000 THEN 'long' END"""


def clean_documents(spark, sf_dir):
    return cl.clean(documents(spark, sf_dir)).select("doc_id", "content", "lang", "source")


def clean_report(spark, sf_dir):
    return cl.clean_report(documents(spark, sf_dir), CAPPED, corpus=["lang"])


def clean_audit(spark, sf_dir):
    audit = cl.clean_audit(documents(spark, sf_dir), CAPPED, corpus=["lang"])
    return audit.select("doc_id", "lang", "encoding_fixed", "removed_by", F.length("content").alias("chars"))


def clean_custom_filter(spark, sf_dir):
    options = cl.CleanOptions(custom_filters=[lambda df: ~F.contains(df["content"], F.lit("@"))])
    return cl.clean_report(documents(spark, sf_dir), options, corpus=["source"])


def fix_encoding_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    broken = F.replace(F.replace("content", F.lit("é"), F.lit("Ã©")), F.lit("è"), F.lit("Ã¨"))
    return docs.select("doc_id", cl.fix_encoding(broken).alias("content"), (broken != F.col("content")).alias("was_broken"))


def strip_html_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", cl.cleaned_text(F.col("html")).alias("content"))


def normalize_whitespace_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", cl.normalize_whitespace(F.col("content")).alias("content"))


def length_filters(spark, sf_dir):
    docs = documents(spark, sf_dir)
    size = F.length("content")
    kept = docs.where((F.length(strip(F.col("content"))) > 0) & (size >= 200) & (size <= 5000))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(size).alias("chars"))


def dedup_exact(spark, sf_dir):
    return drop_exact_duplicates(documents(spark, sf_dir)).select("doc_id", "content", "source")


def dedup_against_benchmark(spark, sf_dir):
    both = documents(spark, sf_dir).select("doc_id", "content").unionByName(
        table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.col("text").alias("content"))
    )
    return drop_known(both, table(spark, sf_dir, "benchmark"), known_content="text").select(
        "doc_id", F.md5("content").alias("digest")
    )


def near_duplicates(spark, sf_dir):
    return drop_near_duplicates(documents(spark, sf_dir)).select("doc_id", F.length("content").alias("chars"))


def _quality(spark, sf_dir, key):
    scores = score_quality(documents(spark, sf_dir), by=[key])
    return rounded(scores, "duplicate_ratio", "noise_ratio", "coverage", "overall")


def quality_by_lang(spark, sf_dir):
    return _quality(spark, sf_dir, "lang")


def quality_by_source(spark, sf_dir):
    return _quality(spark, sf_dir, "source")


def quality_overall(spark, sf_dir):
    scores = score_quality(documents(spark, sf_dir))
    return rounded(scores, "duplicate_ratio", "noise_ratio", "coverage", "overall")


def quality_clean_by_lang(spark, sf_dir):
    """Clean, drop copies, score: the flagship chain."""
    cleaned = cl.clean(documents(spark, sf_dir))
    return rounded(score_quality(cleaned, by=["lang"]), "duplicate_ratio", "noise_ratio", "coverage", "overall")


def sql_quality(relation: str, key: str | None) -> str:
    column = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    stripped = sql_strip("content")
    return f"""
WITH slim AS (
  SELECT {column}md5(content) AS digest, length(content) AS size,
    CASE WHEN length({stripped}) < 20
      OR (length({stripped}) - length(replace({stripped}, ' ', ''))) / greatest(length(content), 1) > 0.5
      THEN 1 ELSE 0 END AS noisy
  FROM ({relation})),
totals AS (
  SELECT {column}count(*) AS total_chunks, count(DISTINCT digest) AS unique_chunks,
    1.0::DOUBLE - count(DISTINCT digest)::DOUBLE / count(*) AS dup, sum(noisy)::DOUBLE / count(*) AS noise,
    least(sum(size)::DOUBLE / count(*) / 500.0, 1.0) AS cov
  FROM slim {group})
SELECT {column}total_chunks, unique_chunks, round(dup, 6) AS duplicate_ratio, round(noise, 6) AS noise_ratio,
  round(cov, 6) AS coverage, round((1 - dup) * 0.4 + (1 - noise) * 0.3 + cov * 0.3, 6) AS overall
FROM totals"""


_FIRST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(content) ORDER BY doc_id) AS rn FROM ({relation}))
WHERE rn = 1"""
_CLEAN_KEPT = f"SELECT * FROM ({_CLEANED}) WHERE length(content) >= 10"
_MARKED = f"""
SELECT *, CASE WHEN step IS NULL AND row_number() OVER (PARTITION BY lang, step IS NULL, md5(content) ORDER BY doc_id) > 1
  THEN 'duplicate' ELSE step END AS removed_by
FROM (SELECT *, {_STEP} AS step, {sql_fix_encoding('text')} <> text AS encoding_fixed FROM ({_CLEANED}))"""

QUERIES = {
    "clean_documents": clean_documents,
    "clean_report": clean_report,
    "clean_audit": clean_audit,
    "clean_custom_filter": clean_custom_filter,
    "fix_encoding_documents": fix_encoding_documents,
    "strip_html_pages": strip_html_pages,
    "normalize_whitespace_documents": normalize_whitespace_documents,
    "length_filters": length_filters,
    "dedup_exact": dedup_exact,
    "dedup_against_benchmark": dedup_against_benchmark,
    "near_duplicates": near_duplicates,
    "quality_by_lang": quality_by_lang,
    "quality_by_source": quality_by_source,
    "quality_overall": quality_overall,
    "quality_clean_by_lang": quality_clean_by_lang,
}

ORACLE = {
    "clean_documents": f"SELECT doc_id, content, lang, source FROM ({_FIRST.format(relation=_CLEAN_KEPT)})",
    "clean_report": f"""
SELECT lang, count(*) AS original_count, count(*) FILTER (encoding_fixed) AS encoding_fixes,
  count(*) FILTER (removed_by = 'empty') AS removed_empty, count(*) FILTER (removed_by = 'short') AS removed_short,
  count(*) FILTER (removed_by = 'long') AS removed_long, count(*) FILTER (removed_by = 'duplicate') AS dedup_count,
  count(*) FILTER (removed_by IS NULL) AS final_count, count(*) FILTER (removed_by IS NOT NULL) AS removed_count
FROM ({_MARKED}) GROUP BY lang""",
    "clean_audit": f"SELECT doc_id, lang, encoding_fixed, removed_by, length(content) AS chars FROM ({_MARKED})",
    "clean_custom_filter": f"""
WITH marked AS (
  SELECT *, CASE WHEN step IS NULL AND row_number() OVER (PARTITION BY source, step IS NULL, md5(content) ORDER BY doc_id) > 1
    THEN 'duplicate' ELSE step END AS s1
  FROM (SELECT *, CASE WHEN length({sql_strip('content')}) = 0 THEN 'empty' WHEN length(content) < 10 THEN 'short' END AS step,
      {sql_fix_encoding('text')} <> text AS encoding_fixed FROM ({_CLEANED}))),
done AS (SELECT *, CASE WHEN s1 IS NULL AND contains(content, '@') THEN 'custom' ELSE s1 END AS removed_by FROM marked)
SELECT source, count(*) AS original_count, count(*) FILTER (encoding_fixed) AS encoding_fixes,
  count(*) FILTER (removed_by = 'empty') AS removed_empty, count(*) FILTER (removed_by = 'short') AS removed_short,
  count(*) FILTER (removed_by = 'long') AS removed_long, count(*) FILTER (removed_by = 'duplicate') AS dedup_count,
  count(*) FILTER (removed_by IS NULL) AS final_count, count(*) FILTER (removed_by IS NOT NULL) AS removed_count
FROM done GROUP BY source""",
    "fix_encoding_documents": f"""
WITH broken AS (SELECT doc_id, text, replace(replace(text, 'é', 'Ã©'), 'è', 'Ã¨') AS b FROM documents)
SELECT doc_id, {sql_fix_encoding('b')} AS content, b <> text AS was_broken FROM broken""",
    "strip_html_pages": f"SELECT page_id, {sql_cleaned('html')} AS content FROM pages",
    "normalize_whitespace_documents": f"SELECT doc_id, {sql_whitespace('text')} AS content FROM documents",
    "length_filters": f"""
SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents
WHERE length({sql_strip('text')}) > 0 AND length(text) BETWEEN 200 AND 5000 GROUP BY lang""",
    "dedup_exact": f"""
SELECT doc_id, content, source FROM ({_FIRST.format(relation="SELECT *, text AS content FROM documents")})""",
    "dedup_against_benchmark": """
WITH both_sets AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)
SELECT doc_id, md5(text) AS digest FROM both_sets WHERE text NOT IN (SELECT text FROM benchmark)""",
    "near_duplicates": f"""
WITH RECURSIVE words AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS early, b.doc_id AS late, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS MATERIALIZED (
  SELECT late, list(early) AS before FROM shared JOIN sizes x ON x.doc_id = early JOIN sizes y ON y.doc_id = late
  WHERE c / (x.n + y.n - c) >= 0.95 GROUP BY late),
placed AS MATERIALIZED (
  SELECT doc_id, coalesce(before, []::BIGINT[]) AS before, row_number() OVER (ORDER BY doc_id) AS p
  FROM documents LEFT JOIN near ON late = doc_id),
walk(p, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT placed.p, CASE WHEN list_has_any(walk.kept, placed.before) THEN walk.kept ELSE list_append(walk.kept, placed.doc_id) END
  FROM walk JOIN placed ON placed.p = walk.p + 1),
final AS (SELECT unnest(kept) AS doc_id FROM walk WHERE p = (SELECT count(*) FROM documents))
SELECT doc_id, length(text)::INT AS chars FROM final JOIN documents USING (doc_id)""",
    "quality_by_lang": sql_quality("SELECT *, text AS content FROM documents", "lang"),
    "quality_by_source": sql_quality("SELECT *, text AS content FROM documents", "source"),
    "quality_overall": sql_quality("SELECT *, text AS content FROM documents", None),
    "quality_clean_by_lang": sql_quality(_FIRST.format(relation=_CLEAN_KEPT), "lang"),
}
