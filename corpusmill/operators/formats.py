"""Render chunks as training records.

Templates rotate by the position of a chunk in input order. Input columns: content, source_ref,
chunk_index and an integer order column (``doc_id`` unless told otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import WHITESPACE, strip, topic
from corpusmill.operators.position import with_position

# The wording of the records.
INSTRUCTION_TEMPLATES = (
    "Explain the following concept:\n{context}",
    "Summarize this information:\n{context}",
    "Based on the following, answer any questions:\n{context}",
    "What are the key points in:\n{context}",
)
QUESTION_TEMPLATES = (
    "What is {topic}?",
    "Can you explain {topic}?",
    "Describe {topic}.",
    "What do you know about {topic}?",
)
CHAT_SYSTEM = "You are a helpful assistant that provides accurate information."
CHAT_TEMPLATES = (
    "Tell me about {topic}.",
    "Can you explain {topic}?",
    "What can you tell me about {topic}?",
    "I'd like to learn about {topic}.",
)
PREFERENCE_TEMPLATES = (
    "Explain {topic}.",
    "What is {topic}?",
    "Describe {topic} in detail.",
    "Provide information about {topic}.",
)
REFUSAL = "I'm not sure about that topic. Can you be more specific?"
TABLE_QUESTIONS = (
    "Show all records from {table}.",
    "How many rows are in {table}?",
    "List everything in the {table} table.",
)
TABLE_QUERIES = (
    "SELECT * FROM {table};",
    "SELECT COUNT(*) FROM {table};",
    "SELECT * FROM {table};",
)
SFT_LAYOUT = ("### Instruction:\n", "\n\n### Response:\n")

CONTEXT_CHARS = 200


def _rotate(templates: Sequence[str], slot: str, value: Column) -> Column:
    choice = F.element_at(
        F.array(*[F.lit(t) for t in templates]), (F.col("position") % len(templates) + 1).cast("int")
    )
    return F.replace(choice, F.lit("{" + slot + "}"), value)


def _positioned(chunks: DataFrame, order_by: str) -> DataFrame:
    ties = ["chunk_index"] if order_by != "chunk_index" else []
    return with_position(chunks, order_by=order_by, ties=ties)


def _origin() -> list[Column]:
    return [F.col("source_ref"), F.col("chunk_index")]


def instruction_pairs(
    chunks: DataFrame, *, templates: Sequence[str] = INSTRUCTION_TEMPLATES, order_by: str = "doc_id"
) -> DataFrame:
    prompt = _rotate(templates, "context", F.substring("content", 1, CONTEXT_CHARS))
    return _positioned(chunks, order_by).select(
        prompt.alias("instruction"), F.col("content").alias("response"), *_origin()
    )


def qa_pairs(chunks: DataFrame, *, templates: Sequence[str] = QUESTION_TEMPLATES, order_by: str = "doc_id") -> DataFrame:
    question = _rotate(templates, "topic", topic(F.col("content")))
    return _positioned(chunks, order_by).select(question.alias("question"), F.col("content").alias("answer"), *_origin())


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_conversations(
    chunks: DataFrame,
    *,
    system_prompt: str = CHAT_SYSTEM,
    templates: Sequence[str] = CHAT_TEMPLATES,
    order_by: str = "doc_id",
) -> DataFrame:
    messages = F.array(
        _message("system", F.lit(system_prompt)),
        _message("user", _rotate(templates, "topic", topic(F.col("content")))),
        _message("assistant", F.col("content")),
    )
    return _positioned(chunks, order_by).select(messages.alias("messages"), *_origin())


def preference_pairs(
    chunks: DataFrame,
    *,
    templates: Sequence[str] = PREFERENCE_TEMPLATES,
    rejected: str = REFUSAL,
    order_by: str = "doc_id",
) -> DataFrame:
    prompt = _rotate(templates, "topic", topic(F.col("content")))
    return _positioned(chunks, order_by).select(
        prompt.alias("prompt"), F.col("content").alias("chosen"), F.lit(rejected).alias("rejected"), *_origin()
    )


def table_name_in(content: Column) -> Column:
    """The table a text speaks of: the word after ``create table`` or ``table``, else its first word."""

    def first_word(text: Column) -> Column:
        word = F.element_at(F.split(strip(text), f"{WHITESPACE}+", 2), 1)
        return F.when(word != "", word)

    def after(keyword: str) -> Column:
        place = F.locate(keyword, F.lower(content))
        word = first_word(F.substr(content, place + F.lit(len(keyword))))
        for mark in ("(", "`", '"'):
            word = F.btrim(word, F.lit(mark))
        return F.when(place > 0, F.coalesce(word, F.lit("unknown")))

    return F.coalesce(after("create table "), after("table "), first_word(content), F.lit("unknown"))


def text_to_sql_pairs(chunks: DataFrame, *, order_by: str = "doc_id") -> DataFrame:
    """The table comes from metadata (``table_name`` or ``table``) when there, else from the text."""
    named = F.lit(None).cast("string")
    if "metadata" in chunks.columns:
        for key in ("table", "table_name"):
            entry = F.try_element_at(F.col("metadata"), F.lit(key))
            named = F.coalesce(F.when(entry != "", entry), named)
    rows = _positioned(chunks, order_by).withColumn("_table", F.coalesce(named, table_name_in(F.col("content"))))
    return rows.select(
        _rotate(TABLE_QUESTIONS, "table", F.col("_table")).alias("question"),
        _rotate(TABLE_QUERIES, "table", F.col("_table")).alias("sql"),
        *_origin(),
    )


def corpus_records(
    chunks: DataFrame,
    *,
    by: Sequence[str] = (),
    separator: str = "\n\n",
    order_by: str = "doc_id",
    record_chunks: int | None = None,
) -> DataFrame:
    """Chunks joined into running text, one corpus per ``by`` value.

    A corpus is one record, part 0, whatever its size; with ``record_chunks`` it is cut into parts of that many chunks, for corpora
    that are too large for a cell. The parts in order hold every chunk.
    """
    ties = ["chunk_index"] if order_by != "chunk_index" else []
    rows = with_position(chunks, order_by=order_by, ties=ties, within=by).withColumn(
        "part", F.floor(F.col("position") / record_chunks).cast("long") if record_chunks else F.lit(0).cast("long")
    )
    members = F.sort_array(F.collect_list(F.struct("position", "content", "source_ref")))
    grouped = rows.groupBy(*by, "part").agg(members.alias("_members"))
    return grouped.select(
        *by,
        "part",
        F.array_join(F.col("_members.content"), separator).alias("text"),
        F.col("_members.source_ref").alias("source_refs"),
        F.size("_members").cast("long").alias("num_chunks"),
    )


def sft_text(pairs: DataFrame, *, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """Instruction pairs as the one text that a trainer reads."""
    head, middle = SFT_LAYOUT
    return pairs.withColumn("text", F.concat(F.lit(head), F.col(instruction), F.lit(middle), F.col(response)))


def chat_sessions(
    messages: DataFrame,
    *,
    session: str,
    turn: str,
    role: str = "role",
    content: str = "content",
) -> DataFrame:
    """Message rows as one record per session, in turn order; turns may be numbers of any size or times."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))))
    grouped = messages.groupBy(F.col(session).alias("session_id")).agg(ordered.alias("_turns"))
    return grouped.select(
        "session_id",
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
    )


def apply_mapping(rows: DataFrame, mapping: dict[str, str], *, keep: Sequence[str] = (), separator: str = "\n\n") -> DataFrame:
    """Rename source columns to the fields of a format; several sources of one field are joined."""
    targets: dict[str, list[str]] = {}
    for source, target in mapping.items():
        targets.setdefault(target, []).append(source)
    fields = [
        (F.col(sources[0]) if len(sources) == 1 else F.concat_ws(separator, *sources)).alias(target)
        for target, sources in targets.items()
    ]
    return rows.select(*keep, *fields)


WRITERS = {
    "instruction": instruction_pairs,
    "qa": qa_pairs,
    "chat": chat_conversations,
    "dpo": preference_pairs,
    "text2sql": text_to_sql_pairs,
    "corpus": corpus_records,
}


def render(chunks: DataFrame, format_name: str, **options) -> DataFrame:
    """Records in the named format; unknown names fall back to instruction pairs."""
    return WRITERS.get(format_name, instruction_pairs)(chunks, **options)
