"""Which training format suits a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.numbers import fixed
from corpusmill.operators.formats import WRITERS, render

# Field names that carry running text, and the order in which formats are tried.
TEXT_FIELDS = ("title", "body", "text", "content", "description", "summary", "abstract", "document")
RULE_ORDER = ("dpo", "qa", "instruction", "chat", "text2sql", "corpus")
KNOWN_FIELDS = (
    "question", "answer", "query", "instruction", "output", "response", "prompt", "chosen", "rejected", "role", "content",
    "session_id",
)
# Fixed values, here and in the rules below: the sentences that give the reason, with their confidences and mappings.
NOTHING_FOUND = {
    "dpo": "No DPO pattern found.",
    "qa": "No QA pattern found.",
    "instruction": "No instruction pattern found.",
    "chat": "No chat pattern found.",
    "text2sql": "Not enough tables for text2sql.",
    "corpus": "No recognized text fields; corpus is the fallback.",
}
ALTERNATIVE_ABOVE = 0.3
ACCEPTED_FROM = 0.4


def _found(confidence: float, mapping: Column, reasoning: Column) -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), mapping.alias("mapping"), reasoning.alias("reasoning"))


def _map(**pairs: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _about(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("collection"), F.lit(after))


def _rules() -> dict[str, Column]:
    """What each rule finds in one collection; null where it does not apply."""

    def has(name: str) -> Column:
        return F.col(f"_has_{name}")

    texts = F.col("_texts")
    text_map = F.map_from_arrays(texts, F.transform(texts, lambda _: F.lit("text")))
    return {
        "dpo": F.when(
            has("prompt") & has("chosen") & has("rejected"),
            _found(
                0.95,
                _map(prompt="prompt", chosen="chosen", rejected="rejected"),
                _about("Table '", "' has prompt/chosen/rejected columns, indicating DPO preference format."),
            ),
        ),
        "qa": F.when(
            has("question") & has("answer"),
            _found(
                0.95,
                _map(question="input", answer="output"),
                _about("Table '", "' has question/answer columns, indicating QA format."),
            ),
        ).when(
            has("query") & has("answer"),
            _found(
                0.85, _map(query="input", answer="output"), _about("Table '", "' has query/answer columns, suggesting QA format.")
            ),
        ),
        "instruction": F.when(
            has("instruction") & has("output"),
            _found(
                0.95,
                _map(instruction="instruction", output="response"),
                _about("Table '", "' has instruction/output columns."),
            ),
        )
        .when(
            has("instruction") & has("response"),
            _found(
                0.95,
                _map(instruction="instruction", response="response"),
                _about("Table '", "' has instruction/response columns."),
            ),
        )
        .when(
            has("prompt") & has("response") & ~has("chosen"),
            _found(
                0.85, _map(prompt="instruction", response="response"), _about("Table '", "' has prompt/response columns.")
            ),
        ),
        "chat": F.when(
            has("role") & has("content") & has("session_id"),
            _found(
                0.95,
                _map(role="role", content="content", session_id="session_id"),
                _about("Collection '", "' has role/content/session_id columns, indicating chat format."),
            ),
        ).when(
            has("role") & has("content"),
            _found(0.7, _map(role="role", content="content"), _about("Collection '", "' has role/content but no session_id.")),
        ),
        "corpus": F.when(
            F.size(texts) >= 2,
            _found(
                0.8,
                text_map,
                F.concat(
                    _about("Table '", "' has text fields ("), F.array_join(texts, ", "), F.lit("), suitable for corpus format.")
                ),
            ),
        ).when(
            F.size(texts) == 1,
            _found(
                0.5,
                text_map,
                F.concat(_about("Table '", "' has a single text field ("), F.array_join(texts, ", "), F.lit(").")),
            ),
        ),
    }


def detect_formats(fields: DataFrame) -> DataFrame:
    """A recommendation per database from catalog rows (database, collection, source_type,
    collection_ordinal, field, relationships). Within a rule the first matching collection counts."""
    name = F.lower("field")
    flags = [F.coalesce(F.bool_or(name == known), F.lit(False)).alias(f"_has_{known}") for known in KNOWN_FIELDS]
    texts = [F.bool_or(name == text).alias(f"_text_{text}") for text in TEXT_FIELDS]
    collections = (
        fields.groupBy("database", "collection")
        .agg(
            F.min("collection_ordinal").alias("_ordinal"),
            (F.max("source_type") == "table").alias("_is_table"),
            (F.max(F.size("relationships")) > 0).alias("_related"),
            *flags,
            *texts,
        )
        .withColumn(
            "_texts",
            F.array_compact(F.array(*[F.when(F.col(f"_text_{text}"), F.lit(text)) for text in TEXT_FIELDS])),
        )
    )
    rules = _rules()
    hits = collections.select(
        "database", "_ordinal", "_is_table", "_related", *[rule.alias(f"_hit_{kind}") for kind, rule in rules.items()]
    )
    firsts = [
        F.min_by(F.col(f"_hit_{kind}"), F.when(F.col(f"_hit_{kind}").isNotNull(), F.col("_ordinal"))).alias(f"_hit_{kind}")
        for kind in rules
    ]
    databases = hits.groupBy("database").agg(
        *firsts, F.count_if("_is_table").alias("_tables"), F.bool_or("_related").alias("_linked")
    )

    tables = F.col("_tables").cast("string")
    schema_map = _map(schema="context")
    enough = F.col("_tables") >= 3
    text2sql = F.when(
        enough & F.col("_linked"),
        _found(
            0.9, schema_map, F.concat(F.lit("Database has "), tables, F.lit(" tables with relationships, suitable for text2sql."))
        ),
    ).when(
        enough,
        _found(0.6, schema_map, F.concat(F.lit("Database has "), tables, F.lit(" tables but no explicit relationships."))),
    )
    nothing = F.create_map().cast("map<string,string>")
    candidates = []
    for place, kind in enumerate(RULE_ORDER):
        hit = text2sql if kind == "text2sql" else F.col(f"_hit_{kind}")
        miss = _found(0.2 if kind == "corpus" else 0.0, nothing, F.lit(NOTHING_FOUND[kind]))
        best = F.coalesce(hit, miss)
        candidates.append(
            F.struct(
                (-best["confidence"]).alias("order"),
                F.lit(place).alias("place"),
                F.lit(kind).alias("format"),
                best["confidence"].alias("confidence"),
                best["mapping"].alias("mapping"),
                best["reasoning"].alias("reasoning"),
            )
        )

    def by_confidence(a: Column, b: Column) -> Column:
        return (
            F.when(a["order"] != b["order"], F.when(a["order"] < b["order"], -1).otherwise(1))
            .when(a["place"] < b["place"], -1)
            .otherwise(1)
        )

    ranked = databases.withColumn("_ranked", F.array_sort(F.array(*candidates), by_confidence))
    best = F.col("_ranked")[0]
    weak = best["confidence"] < ACCEPTED_FROM
    others = F.filter(F.slice("_ranked", 2, len(RULE_ORDER)), lambda c: c["confidence"] > ALTERNATIVE_ABOVE)
    not_corpus = F.filter("_ranked", lambda c: c["format"] != "corpus")
    return ranked.select(
        "database",
        F.when(weak, "corpus").otherwise(best["format"]).alias("primary_format"),
        best["confidence"].alias("confidence"),
        F.transform(F.when(weak, not_corpus).otherwise(others), lambda c: c["format"]).alias("alternatives"),
        F.when(weak, nothing).otherwise(best["mapping"]).alias("column_mapping"),
        F.when(
            weak,
            F.format_string(
                "No strong pattern detected (best match: %s at %s). Falling back to corpus format.",
                best["format"],
                fixed(best["confidence"], 2),
            ),
        )
        .otherwise(best["reasoning"])
        .alias("reasoning"),
    )


def render_detected(chunks: DataFrame, fields: DataFrame | None = None, *, database: str | None = None, **options) -> DataFrame:
    """Records in the format that the schema of a database suits; instruction pairs without one.

    ``database`` names it if the catalog has several; without a name that is an error.
    """
    chosen = "instruction"
    if fields is not None:
        found = detect_formats(fields if database is None else fields.where(F.col("database") == database))
        answers = found.select("primary_format", "confidence").limit(2).collect()
        if len(answers) > 1:
            raise ValueError("the catalog has several databases: name one")
        answer = answers[0] if answers else None
        if answer is not None and answer["confidence"] >= ACCEPTED_FROM:
            chosen = answer["primary_format"]
    return render(chunks, chosen if chosen in WRITERS else "instruction", **options)
