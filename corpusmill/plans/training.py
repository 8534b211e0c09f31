"""Training records, augmentation, balancing and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import augment, formats
from corpusmill.plans.common import SQL_WS, documents, sql_list, sql_strip, table


def _doc_chunks(spark, sf_dir):
    """Every document as one chunk."""
    return documents(spark, sf_dir).select("doc_id", "content", "source_ref", F.lit(0).alias("chunk_index"), "source")


def fmt_instruction(spark, sf_dir):
    return formats.instruction_pairs(_doc_chunks(spark, sf_dir))


def fmt_qa(spark, sf_dir):
    return formats.qa_pairs(_doc_chunks(spark, sf_dir))


def fmt_chat(spark, sf_dir):
    records = formats.chat_conversations(_doc_chunks(spark, sf_dir))
    return records.select(F.to_json("messages").alias("messages"), "source_ref", "chunk_index")


def fmt_dpo(spark, sf_dir):
    return formats.preference_pairs(_doc_chunks(spark, sf_dir))


def fmt_text2sql(spark, sf_dir):
    """Half of the parts carry their table in the metadata, the others only in the text."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("CREATE TABLE `"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("` (id INT)")).alias("content"),
        F.concat(F.lit("part://"), F.col("p_type")).alias("source_ref"),
        F.lit(0).alias("chunk_index"),
        F.create_map(F.lit("table"), F.when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit("_")))).alias("metadata"),
    )
    return formats.text_to_sql_pairs(parts)


RECORD_CHUNKS = 16


def fmt_corpus(spark, sf_dir):
    records = formats.corpus_records(_doc_chunks(spark, sf_dir), by=["source"], record_chunks=RECORD_CHUNKS)
    return records.select("source", "part", "text", F.array_join("source_refs", ",").alias("source_refs"), "num_chunks")


def sft_text(spark, sf_dir):
    return formats.sft_text(fmt_instruction(spark, sf_dir)).select("text", "source_ref")


def chat_sessions(spark, sf_dir):
    mapped = formats.apply_mapping(
        table(spark, sf_dir, "conversations"), {"role": "role", "text": "content", "conv_id": "session_id"}, keep=["turn"]
    )
    sessions = formats.chat_sessions(mapped, session="session_id", turn="turn")
    return sessions.select("session_id", F.to_json("messages").alias("messages"))


def column_mapping(spark, sf_dir):
    """Two source columns joined into one target field, the rest renamed."""
    rows = table(spark, sf_dir, "part")
    return formats.apply_mapping(rows, {"p_name": "text", "p_type": "text", "p_brand": "label"}, keep=["p_partkey"], separator=" / ")


def augment_synonyms(spark, sf_dir):
    """Texts rewritten so that dictionary words occur in all of them."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", _with_words("text").alias("text"))
    return augment.augment_synonyms(rows, id_column="item_id", target_multiplier=2.5)


def augment_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", _with_words("content").alias("content"))
    return augment.augment_synonyms(rows, id_column="doc_id", target_multiplier=1.5, preserve_originals=False)


def _with_words(column):
    return F.replace(F.replace(column, F.lit(" the "), F.lit(" Good ")), F.lit(" la "), F.lit(" explain "))


def balance_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return augment.balance_categories(rows, category="p_brand", id_column="p_partkey")


def balanced_counts(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang")
    balanced = augment.with_balanced(rows, category="lang", id_column="doc_id", target_multiplier=1.0)
    return balanced.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"))


def holdout_split(spark, sf_dir):
    return augment.holdout_split(documents(spark, sf_dir).select("doc_id", "lang"), id_column="doc_id")


def comparison_sample(spark, sf_dir):
    return augment.comparison_sample(documents(spark, sf_dir).select("doc_id", "content"), id_column="doc_id")


def _rotated(templates, slot, value):
    return f"replace([{sql_list(templates)}][(position % {len(templates)} + 1)::INT], '{{{slot}}}', {value})"


_TOPIC = sql_strip("rtrim(substring(text, 1, 80), '.')")
_PLACED = """(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS position, 'documents://' || source AS source_ref,
  0 AS chunk_index FROM documents)"""
_INSTRUCTION = _rotated(formats.INSTRUCTION_TEMPLATES, "context", "substring(text, 1, 200)")


def sql_hash(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 8))::BIGINT"


def sql_swap(text: str, *seed: str) -> str:
    keys = sql_list(augment.SYNONYMS)
    values = ", ".join(f"[{sql_list(others)}]" for others in augment.SYNONYMS.values())
    lookup = f"MAP {{{', '.join(f'{chr(39)}{w}{chr(39)}: [{sql_list(o)}]' for w, o in augment.SYNONYMS.items())}}}"
    assert keys and values
    options = f"({lookup})[lower(w)]"
    pick = f"{options}[({sql_hash(*seed, 'i - 1')} % len({options}) + 1)::INT]"
    capital = "left(w, 1) = upper(left(w, 1)) AND left(w, 1) <> lower(left(w, 1))"
    words = f"list_filter(string_split_regex({text}, '{SQL_WS}+'), lambda w: w <> '')"
    return f"""array_to_string(list_transform({words}, lambda w, i: CASE WHEN {options} IS NULL THEN w
      WHEN {capital} THEN upper(left({pick}, 1)) || substr({pick}, 2) ELSE {pick} END), ' ')"""


def _sql_words(column):
    return f"replace(replace({column}, ' the ', ' Good '), ' la ', ' explain ')"


def _sql_augment(relation, key, text, multiplier, originals):
    needed = f"(floor(n * {multiplier}) - n)" if originals else f"floor(n * {multiplier})"
    base = f"SELECT {key}, {text}, 0::BIGINT AS copy FROM src UNION ALL" if originals else ""
    return f"""
WITH src AS ({relation}),
placed AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS p, count(*) OVER () AS n FROM src),
rounds AS (SELECT *, unnest(range(1, greatest(ceil(({needed} - p) / n), 0)::BIGINT + 1)) AS copy FROM placed)
{base} SELECT {key}, {sql_swap(text, "'0'", key, "copy", f"'{text}'")} AS {text}, copy FROM rounds"""


QUERIES = {
    "fmt_instruction": fmt_instruction,
    "fmt_qa": fmt_qa,
    "fmt_chat": fmt_chat,
    "fmt_dpo": fmt_dpo,
    "fmt_text2sql": fmt_text2sql,
    "fmt_corpus": fmt_corpus,
    "sft_text": sft_text,
    "chat_sessions": chat_sessions,
    "column_mapping": column_mapping,
    "augment_synonyms": augment_synonyms,
    "augment_documents": augment_documents,
    "balance_categories": balance_categories,
    "balanced_counts": balanced_counts,
    "holdout_split": holdout_split,
    "comparison_sample": comparison_sample,
}

ORACLE = {
    "fmt_instruction": f"SELECT {_INSTRUCTION} AS instruction, text AS response, source_ref, chunk_index FROM {_PLACED}",
    "fmt_qa": f"""
SELECT {_rotated(formats.QUESTION_TEMPLATES, 'topic', _TOPIC)} AS question, text AS answer, source_ref, chunk_index
FROM {_PLACED}""",
    "fmt_chat": f"""
SELECT to_json([{{'role': 'system', 'content': '{formats.CHAT_SYSTEM}'}},
  {{'role': 'user', 'content': {_rotated(formats.CHAT_TEMPLATES, 'topic', _TOPIC)}}},
  {{'role': 'assistant', 'content': text}}])::VARCHAR AS messages, source_ref, chunk_index FROM {_PLACED}""",
    "fmt_dpo": f"""
SELECT {_rotated(formats.PREFERENCE_TEMPLATES, 'topic', _TOPIC)} AS prompt, text AS chosen,
  {sql_list([formats.REFUSAL])} AS rejected, source_ref, chunk_index FROM {_PLACED}""",
    "fmt_text2sql": f"""
WITH placed AS (
  SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, 'part://' || p_type AS source_ref, 0 AS chunk_index,
    CASE WHEN p_size > 25 THEN replace(p_name, ' ', '_') ELSE replace(p_brand, '#', '_') END AS t FROM part)
SELECT {_rotated(formats.TABLE_QUESTIONS, 'table', 't')} AS question, {_rotated(formats.TABLE_QUERIES, 'table', 't')} AS sql,
  source_ref, chunk_index FROM placed""",
    "fmt_corpus": f"""
WITH placed AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {RECORD_CHUNKS} AS part FROM documents)
SELECT source, part, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text,
  string_agg('documents://' || source, ',' ORDER BY doc_id) AS source_refs, count(*) AS num_chunks
FROM placed GROUP BY source, part""",
    "sft_text": f"""
SELECT '### Instruction:' || chr(10) || {_INSTRUCTION} || chr(10) || chr(10) || '### Response:' || chr(10) || text AS text, source_ref
FROM {_PLACED}""",
    "chat_sessions": """
SELECT conv_id AS session_id,
  to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages
FROM conversations GROUP BY ALL""",
    "column_mapping": "SELECT p_partkey, p_name || ' / ' || p_type AS text, p_brand AS label FROM part",
    "augment_synonyms": _sql_augment(
        f"SELECT item_id, {_sql_words('text')} AS text FROM benchmark", "item_id", "text", 2.5, True
    ),
    "augment_documents": _sql_augment(
        f"SELECT doc_id, {_sql_words('text')} AS content FROM documents", "doc_id", "content", 1.5, False
    ),
    "balance_categories": """
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p,
    count(*) OVER (PARTITION BY p_brand) AS n FROM part),
top AS (SELECT floor(max(n) * 2.0) AS target FROM placed)
SELECT p_partkey, p_brand, unnest(range(0, greatest(ceil((target - n - p) / n), 0)::BIGINT)) AS copy FROM placed, top""",
    "balanced_counts": """
WITH counts AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, (SELECT max(n) FROM counts) AS rows, n AS documents FROM counts""",
    "holdout_split": f"""
SELECT doc_id, lang, CASE WHEN {sql_hash("'0'", 'doc_id')} % 1000 < 100 THEN 'test' ELSE 'train' END AS split FROM documents""",
    "comparison_sample": f"""
SELECT doc_id, text AS content FROM documents ORDER BY {sql_hash("'0'", 'doc_id')}, doc_id LIMIT 50""",
}
