import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill import pipeline
from corpusmill.operators import augment, catalog, detect, formats, mapping
from corpusmill.operators.catalog import Collection, catalog_fields
from corpusmill.operators import position
from corpusmill.operators.position import with_minimum_before, with_position


@pytest.fixture
def chunks(docs):
    def build(texts):
        return docs(texts).withColumn("chunk_index", F.lit(0))

    return build


def test_positions_do_not_depend_on_segments(spark):
    rows = spark.range(0, 1000, 7).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("g")).repartition(6)
    expected = {}
    for doc_id in range(0, 1000, 7):
        expected[doc_id] = sum(1 for other in range(0, doc_id, 7) if other % 5 == doc_id % 5)
    for segment in (3, 64, 10**6):
        placed = with_position(rows, order_by="doc_id", within=["g"], segment=segment, total="n")
        assert {r["doc_id"]: r["position"] for r in placed.collect()} == expected
        assert {r["n"] for r in placed.collect()} == {28, 29}


@pytest.mark.parametrize("fan", [1 << 17, 4])
def test_positions_of_hashed_ids(spark, monkeypatch, fan):
    """Ids all over the range of 64 bits, ties and nulls; no window sees more than a block of segments."""
    monkeypatch.setattr(position, "FAN", fan)
    rng = random.Random(fan)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [-(2**63), 2**63 - 1, 0, 0, -1, None, None]
    rows = spark.createDataFrame([(v, i, rng.choice(["a", None])) for i, v in enumerate(ids)], "k long, t long, g string").repartition(5)
    table = [tuple(r) for r in rows.collect()]
    for within in ([], ["g"]):
        placed = with_position(rows, order_by="k", ties=["t"], within=within, total="n").collect()
        assert len(placed) == len(table)
        for r in placed:
            group = sorted((x for x in table if not within or x[2] == r["g"]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            assert (r["position"], r["n"]) == ([x[1] for x in group].index(r["t"]), len(group))
    seen = with_minimum_before(rows.where("k IS NOT NULL AND t < 300"), {"low": F.col("t")}, order_by="k")
    order = sorted(x for x in table if x[0] is not None and x[1] < 300)
    lows = {x[0]: min((y[1] for y in order[:i]), default=None) for i, x in enumerate(order)}
    assert {r["k"]: r["low"] for r in seen.collect()} == lows


def test_minimum_before_across_segments(spark):
    values = [5, 3, 8, 3, 2, 9, None, 1, 4]
    rows = spark.createDataFrame(list(enumerate(values)), "idx long, v int").repartition(3)
    expected = {i: min((v for v in values[:i] if v is not None), default=None) for i in range(len(values))}
    for segment in (1, 2, 100):
        seen = with_minimum_before(rows, {"low": F.col("v")}, order_by="idx", segment=segment)
        assert {r["idx"]: r["low"] for r in seen.collect()} == expected


def test_instruction_rotation(chunks):
    texts = [f"Text {i}. More of it" for i in range(9)]
    rows = formats.instruction_pairs(chunks(texts)).collect()
    found = {r["source_ref"]: r["instruction"] for r in rows}
    assert found == {f"ref{i}": formats.INSTRUCTION_TEMPLATES[i % 4].format(context=t) for i, t in enumerate(texts)}


def test_qa_and_preferences(chunks):
    long = "w" * 79 + ".tail that is cut off"
    qa = {r["source_ref"]: (r["question"], r["answer"]) for r in formats.qa_pairs(chunks(["A topic.", long])).collect()}
    assert qa == {"ref0": ("What is A topic?", "A topic."), "ref1": (f"Can you explain {'w' * 79}?", long)}
    pair = formats.preference_pairs(chunks(["A topic."])).first()
    assert (pair["prompt"], pair["chosen"], pair["rejected"]) == ("Explain A topic.", "A topic.", formats.REFUSAL)


def test_chat(chunks):
    messages = formats.chat_conversations(chunks(["One sentence."])).first()["messages"]
    assert [m["role"] for m in messages] == ["system", "user", "assistant"]
    assert messages[1]["content"] == "Tell me about One sentence."


@pytest.mark.parametrize(
    "text, name",
    [
        ("CREATE TABLE users (id INT)", "users"),
        ("create table `orders`(id)", "`orders`(id)".strip("(").strip("`")),
        ("The Table accounts holds", "accounts"),
        ("inventory of parts", "inventory"),
        ("ends with table ", "unknown"),
        ("  ", "unknown"),
    ],
)
def test_table_names(spark, text, name):
    row = spark.createDataFrame([(text,)], "t string").select(formats.table_name_in(F.col("t")).alias("n")).first()
    assert row["n"] == name


def test_text_to_sql(chunks):
    rows = chunks(["CREATE TABLE users (...)", "CREATE TABLE orders (...)"]).withColumn(
        "metadata", F.create_map(F.lit("table_name"), F.element_at(F.split("content", " "), 3))
    )
    assert [r["sql"] for r in formats.text_to_sql_pairs(rows).orderBy(F.desc("source_ref")).collect()][::-1] == [
        "SELECT * FROM users;",
        "SELECT COUNT(*) FROM orders;",
    ]


def test_corpus_parts_hold_every_chunk(chunks):
    texts = [f"Paragraph {i}" for i in range(10)]
    whole = formats.corpus_records(chunks(texts)).collect()
    assert [r["text"] for r in whole] == ["\n\n".join(texts)] and whole[0]["num_chunks"] == 10
    parts = formats.corpus_records(chunks(texts), record_chunks=4).orderBy("part").collect()
    assert "\n\n".join(r["text"] for r in parts) == "\n\n".join(texts) and len(parts) == 3


def test_sessions_are_whole_whatever_the_turns(spark):
    times = [(1, 1_700_000_000 + 977 * k, "user", f"m{k}") for k in range(1500)]
    rows = spark.createDataFrame(times + [(2, 5, "user", "x")], "s int, t long, role string, content string").repartition(3)
    got = {r["session_id"]: [m["content"] for m in r["messages"]] for r in formats.chat_sessions(rows, session="s", turn="t").collect()}
    assert got == {1: [f"m{k}" for k in range(1500)], 2: ["x"]}


def test_catalog_chooses_the_format(spark):
    faq = spark.createDataFrame([(1, "q", "a")], "id int, question string, answer string")
    keys = spark.createDataFrame([(1, "v")], "key int, value string")
    catalog = [catalog_fields(d, {"t": Collection(f, [f.columns[0]])}) for d, f in (("one", faq), ("two", keys))]
    documents = spark.createDataFrame([(1, "A text that is long enough to be kept.", "ref")], "doc_id long, content string, source_ref string")
    assert "question" in pipeline.prepare(documents, catalog=catalog[0]).records.columns
    both = catalog[0].unionByName(catalog[1])
    assert "question" in pipeline.prepare(documents, catalog=both, database="one").records.columns
    with pytest.raises(ValueError):
        pipeline.prepare(documents, catalog=both)


def test_synonyms(spark):
    rows = spark.createDataFrame([(0, "Good  day,\tshow big things", 1)], "id long, t string, n int")
    variant = augment.augment_synonyms(rows, id_column="id").where("copy = 1").first()["t"].split(" ")
    assert variant[0].lower() in augment.SYNONYMS["good"] and variant[0][0].isupper()
    assert variant[1] == "day," and variant[2] in augment.SYNONYMS["show"] and variant[3] in augment.SYNONYMS["big"]


@pytest.mark.parametrize("multiplier, keep, total", [(2.0, True, 14), (2.5, True, 17), (3.4, False, 23), (0.5, True, 7)])
def test_round_robin_counts(spark, multiplier, keep, total):
    rows = spark.range(7).select(F.col("id"), F.lit("use it").alias("t")).repartition(3)
    result = augment.augment_synonyms(rows, id_column="id", target_multiplier=multiplier, preserve_originals=keep, segment=2)
    counts = [r["count"] for r in result.groupBy("id").count().orderBy("id").collect()]
    assert sum(counts) == total and sorted(counts, reverse=True) == counts and max(counts) - min(counts) <= 1


def test_balance(spark, monkeypatch):
    monkeypatch.setattr(augment, "COPIES_PER_BLOCK", 3)
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aaaaabb")] + [(7, None)], "id long, c string")
    copies = augment.balance_categories(rows, category="c", id_column="id", target_multiplier=2.0, segment=2)
    counts = {r["id"]: r["count"] for r in copies.groupBy("id").count().collect()}
    assert counts == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 4, 6: 4}


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    split = [augment.holdout_split(rows.repartition(n), id_column="doc_id").where("split = 'test'") for n in (1, 7)]
    first, second = [{r["doc_id"] for r in s.collect()} for s in split]
    assert first == second and 140 < len(first) < 260
    assert augment.comparison_sample(rows, id_column="doc_id").count() == 50


def schema(spark, collections, relationships=()):
    rows = [
        ("db", name, "table", place, field, list(relationships))
        for place, (name, fields) in enumerate(collections)
        for field in fields
    ]
    return spark.createDataFrame(
        rows, "database string, collection string, source_type string, collection_ordinal int, field string, relationships array<string>"
    )


@pytest.mark.parametrize(
    "collections, related, best, confidence",
    [
        ([("faq", ["id", "Question", "answer"])], [], "qa", 0.95),
        ([("faq", ["query", "answer"])], [], "qa", 0.85),
        ([("training", ["instruction", "response"])], [], "instruction", 0.95),
        ([("training", ["prompt", "response"])], [], "instruction", 0.85),
        ([("prefs", ["prompt", "chosen", "rejected"])], [], "dpo", 0.95),
        ([("messages", ["role", "content", "session_id"])], [], "chat", 0.95),
        ([("messages", ["role", "content"])], [], "chat", 0.7),
        ([("users", ["id"]), ("orders", ["id"]), ("products", ["id"])], ["users"], "text2sql", 0.9),
        ([("users", ["id"]), ("orders", ["id"]), ("products", ["id"])], [], "text2sql", 0.6),
        ([("articles", ["id", "title", "body"])], [], "corpus", 0.8),
        ([("notes", ["id", "summary"])], [], "corpus", 0.5),
        ([("keys", ["key", "value"])], [], "corpus", 0.2),
    ],
)
def test_detection(spark, collections, related, best, confidence):
    row = detect.detect_formats(schema(spark, collections, related)).first()
    assert (row["primary_format"], row["confidence"]) == (best, confidence)


def test_first_matching_collection_and_alternatives(spark):
    row = detect.detect_formats(
        schema(spark, [("b", ["query", "answer", "text"]), ("a", ["question", "answer", "role", "content"])])
    ).first()
    assert row["primary_format"] == "qa" and row["confidence"] == 0.85 and "'b'" in row["reasoning"]
    assert row["alternatives"] == ["chat", "corpus"] and row["column_mapping"] == {"query": "input", "answer": "output"}


def test_render_without_schema(chunks):
    assert "instruction" in detect.render_detected(chunks(["A text"])).columns


def test_descriptions(spark):
    fields = spark.createDataFrame(
        [("orders", 0, "id", "INTEGER"), ("orders", 1, "user_id", "VARCHAR(100)")],
        "collection string, ordinal int, field string, store_type string",
    )
    links = spark.createDataFrame([("orders", "user_id", "users", "id")], "collection string, field string, ref_table string, ref_field string")
    assert catalog.describe_tables(fields, links).first()["description"] == (
        "The 'orders' table stores records with 2 column(s). Columns: 'id' (INTEGER), 'user_id' (VARCHAR(100)). "
        "Relationships: user_id references 'users' (id)."
    )


@pytest.mark.parametrize("bad, approved, word", [(0, True, None), (1, True, "auto-approved"), (4, False, "explicit"), (50, False, "blocked")])
def test_mapping_gates(spark, bad, approved, word):
    rows = spark.createDataFrame([(i, None if i < bad else "x") for i in range(100)], "id int, question string")
    report = mapping.mapping_report(rows, {"question": "input"}).first()
    assert report["approved"] is approved and report["coverage_pct"] == 100 - bad
    assert (report["warning"] is None) if word is None else (word in report["warning"])


def test_missing_column_invalidates_all(spark):
    rows = spark.createDataFrame([(1, "q"), (2, None)], "id int, question string")
    assert mapping.mapping_report(rows, {"nope": "input"}).first()["valid_records"] == 0
    errors = mapping.mapping_errors(rows, {"nope": "input", "question": "q"}, keep=["id"])
    assert {(r["id"], r["field"], r["error_type"]) for r in errors.collect()} == {
        (1, "nope", "missing_column"), (2, "nope", "missing_column"), (2, "question", "null_value"),
    }


def test_json_fields(spark):
    rows = spark.createDataFrame(
        [("c", 1, json.dumps([{"_id": 7, "ok": True, "x": 1.5, "tags": [], "o": {}, "s": "t", "n": None}])), ("c", 2, "{}")],
        "collection string, ordinal int, body string",
    )
    fields = catalog.fields_from_json(rows, collection=F.col("collection"), content=F.col("body"), order_by=["ordinal"])
    assert {r["field"]: r["data_type"] for r in fields.collect()} == {
        "_id": "integer", "ok": "boolean", "x": "float", "tags": "json", "o": "json", "s": "string", "n": "string",
    }
