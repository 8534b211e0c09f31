"""Chunks and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.chunk import chunk_documents
from corpusmill.operators.entities import PATTERNS, count_entities, extract_entities
from corpusmill.operators.quality import score_quality
from corpusmill.plans.common import SQL_WS, documents, rounded, sql_strip, table
from corpusmill.plans.cleaning import sql_quality


def _chunks(spark, sf_dir, size=1000):
    return chunk_documents(documents(spark, sf_dir), max_chunk_size=size)


def chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "content")


def chunk_stats(spark, sf_dir):
    sizes = _chunks(spark, sf_dir, 500).withColumn("size", F.length("content"))
    return sizes.groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.max("chunk_index").cast("long").alias("last_index"),
        F.max("size").cast("long").alias("longest"),
        F.sum("size").alias("chars"),
    )


def chunk_quality(spark, sf_dir):
    scores = score_quality(_chunks(spark, sf_dir), by=["lang"])
    return rounded(scores, "duplicate_ratio", "noise_ratio", "coverage", "overall")


def page_paragraph_chunks(spark, sf_dir):
    """Paragraph packing: every closing tag of a page ends a paragraph."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.replace("html", F.lit("</"), F.lit("\n \n</")).alias("content")
    )
    return chunk_documents(pages, max_chunk_size=300)


def entities(spark, sf_dir):
    return extract_entities(documents(spark, sf_dir).select("doc_id", "content"))


def entities_in_pages(spark, sf_dir):
    return extract_entities(
        table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("content"))
    )


def entity_counts(spark, sf_dir):
    return count_entities(documents(spark, sf_dir), by=("lang",))


def entity_counts_by_chunk(spark, sf_dir):
    found = extract_entities(_chunks(spark, sf_dir).select("doc_id", "chunk_index", "content"))
    return found.groupBy("label").agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("doc_id", "chunk_index").alias("chunks")
    )


def sql_chunks(relation: str, key: str, limit: int) -> str:
    """The same greedy packing as a fold over list elements."""
    blank = "{'done': []::VARCHAR[], 'open': '', 'size': 0, 'run': -1, 'text': '', 'psize': 0, 'glue': '', 'prun': -1}"

    def piece(text: str, glue: str, run: str) -> str:
        return (
            f"{{'done': []::VARCHAR[], 'open': '', 'size': 0, 'run': -1, 'text': {text}, 'psize': length({text})::INT, "
            f"'glue': {glue}, 'prun': ({run})::INT}}"
        )

    sentences = rf"string_split_regex(regexp_replace(p, '([.!?]){SQL_WS}+', '\1' || chr(1), 'g'), chr(1))"
    fits = f"s.run = x.prun AND s.size > 0 AND s.size + x.psize + 1 <= {limit}"
    return f"""
WITH texts AS (SELECT {key}, {sql_strip('content')} AS t FROM ({relation})),
paragraphs AS (
  SELECT {key}, t, list_filter(list_transform(string_split_regex(t, '\\n{SQL_WS}*\\n'), lambda p: {sql_strip('p')}),
    lambda p: p <> '') AS ps FROM texts),
pieces AS (
  SELECT {key}, t, flatten(list_transform(ps, lambda p, i: CASE WHEN length(p) > {limit}
    THEN list_transform({sentences}, lambda s: {piece('s', "' '", 'i')})
    ELSE [{piece('p', 'chr(10) || chr(10)', '-1')}] END)) AS items FROM paragraphs),
folded AS (
  SELECT {key}, t, list_reduce(items, lambda s, x: {{
      'done': CASE WHEN {fits} OR s.size = 0 THEN s.done ELSE list_append(s.done, s.open) END,
      'open': CASE WHEN {fits} THEN s.open || x.glue || x.text ELSE x.text END,
      'size': CASE WHEN {fits} THEN s.size + x.psize + length(x.glue) ELSE x.psize END::INT,
      'run': CASE WHEN {fits} THEN s.run ELSE x.prun END,
      'text': '', 'psize': 0, 'glue': '', 'prun': -1}}, {blank}) AS f FROM pieces),
listed AS (
  SELECT {key}, CASE WHEN length(t) <= {limit} THEN [t] ELSE list_append(f.done, f.open) END AS cs FROM folded)
SELECT {key}, unnest(cs) AS content, (generate_subscripts(cs, 1) - 1)::INT AS chunk_index FROM listed"""


def sql_entities(relation: str, key: str) -> str:
    parts = []
    for order, (label, (pattern, _)) in enumerate(PATTERNS.items()):
        parts.append(f"""
  SELECT {key}, '{label}' AS label, regexp_extract_all(content, '{pattern}') AS ms,
    string_split_regex(content, '{pattern}') AS gs FROM ({relation})""")
    return f"""
WITH found AS ({' UNION ALL '.join(parts)}),
places AS (SELECT {key}, label, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM found WHERE len(ms) > 0),
spans AS (SELECT *, list_sum(list_transform(gs[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS b FROM places)
SELECT {key}, label, ms[i] AS text, b::INT AS "start", (b + length(ms[i]))::INT AS "end", 1.0::DOUBLE AS confidence FROM spans"""


_DOCS = "SELECT *, text AS content FROM documents"
_PAGE_GAPS = "SELECT page_id, replace(html, '</', chr(10) || ' ' || chr(10) || '</') AS content FROM pages"
_PAGE_TEXT = "SELECT page_id, concat_ws(' ', url, html) AS content FROM pages"

QUERIES = {
    "chunk_documents": chunks,
    "chunk_stats": chunk_stats,
    "chunk_quality": chunk_quality,
    "page_paragraph_chunks": page_paragraph_chunks,
    "entities": entities,
    "entities_in_pages": entities_in_pages,
    "entity_counts": entity_counts,
    "entity_counts_by_chunk": entity_counts_by_chunk,
}

ORACLE = {
    "chunk_documents": sql_chunks(_DOCS, "doc_id", 1000),
    "chunk_stats": f"""
SELECT lang, count(*) AS chunks, max(chunk_index)::BIGINT AS last_index, max(length(content))::BIGINT AS longest,
  sum(length(content))::BIGINT AS chars
FROM ({sql_chunks(_DOCS, 'doc_id', 500)}) JOIN documents USING (doc_id) GROUP BY lang""",
    "chunk_quality": sql_quality(
        f"SELECT lang, content FROM ({sql_chunks(_DOCS, 'doc_id', 1000)}) JOIN documents USING (doc_id)", "lang"
    ),
    "page_paragraph_chunks": sql_chunks(_PAGE_GAPS, "page_id", 300),
    "entities": sql_entities(_DOCS, "doc_id"),
    "entities_in_pages": sql_entities(_PAGE_TEXT, "page_id"),
    "entity_counts": "SELECT lang, label, sum(n)::BIGINT AS entities FROM ("
    + " UNION ALL ".join(
        f"SELECT lang, '{label}' AS label, len(regexp_extract_all(text, '{pattern}')) AS n FROM documents"
        for label, (pattern, _) in PATTERNS.items()
    )
    + ") GROUP BY lang, label",
    "entity_counts_by_chunk": f"""
SELECT label, count(*) AS entities, count(DISTINCT (doc_id, chunk_index)) AS chunks FROM (
  {sql_entities(f"SELECT doc_id * 1000000 + chunk_index AS k, doc_id, chunk_index, content FROM ({sql_chunks(_DOCS, 'doc_id', 1000)})", 'doc_id, chunk_index')})
GROUP BY label""",
}
