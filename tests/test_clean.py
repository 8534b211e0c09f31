import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import strip, tokens
from corpusmill.operators import clean as cl
from corpusmill.operators.dedup import drop_exact_duplicates, drop_known
from corpusmill.operators.quality import score_quality


def kept(df):
    return {r["doc_id"]: r["content"] for r in df.collect()}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_empty_documents_go(docs):
    report = cl.clean_report(docs(["Hello world", "", "   "])).first()
    assert report["removed_count"] == 2 and report["removed_empty"] == 2 and report["final_count"] == 1


def test_first_copy_stays(docs):
    texts = ["Same content here", "Same content here", "Different content"]
    assert kept(cl.clean(docs(texts))) == {0: "Same content here", 2: "Different content"}
    assert cl.clean_report(docs(texts)).first()["dedup_count"] == 1


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("Hello   world\n\n\nfoo   bar", "Hello world\nfoo bar"),
        ("\t\n  tabs\tand spaces  \n", "tabs and spaces"),
        ("<p>Hello <b>world</b></p>", "Hello world"),
        ("a < b > c", "a  c".replace("  ", " ")),
        ("café naïve", "café naïve"),
    ],
)
def test_cleaned_text(spark, text, cleaned):
    assert one(spark, text, cl.cleaned_text) == cleaned


@pytest.mark.parametrize("broken, good", cl.MOJIBAKE)
def test_mojibake(spark, broken, good):
    assert one(spark, f"x{broken}y", cl.fix_encoding) == f"x{good}y"


def test_length_limits(docs):
    texts = ["Short", "This is a sufficiently long document", "x" * 60]
    options = cl.CleanOptions(max_content_length=50)
    assert kept(cl.clean(docs(texts), options)) == {1: texts[1]}
    report = cl.clean_report(docs(texts), options).first()
    assert (report["removed_short"], report["removed_long"]) == (1, 1)


def test_custom_filters_come_last(docs):
    texts = ["keep this document", "drop this document", "drop this document"]
    options = cl.CleanOptions(custom_filters=[F.startswith("content", F.lit("keep"))])
    assert kept(cl.clean(docs(texts), options)) == {0: texts[0]}
    audit = {r["doc_id"]: r["removed_by"] for r in cl.clean_audit(docs(texts), options).collect()}
    assert audit == {0: None, 1: "custom", 2: "duplicate"}
    assert cl.clean_report(docs(texts), options).first()["removed_count"] == 2


def test_report_and_audit_agree(docs):
    texts = ["Ã©lan vital here", "same text again", "same text again", "tiny", " ", "y" * 40]
    audit = cl.clean_audit(docs(texts))
    by_step = {r["removed_by"]: r["n"] for r in audit.groupBy("removed_by").agg(F.count("*").alias("n")).collect()}
    report = cl.clean_report(docs(texts)).first()
    assert by_step == {None: 3, "duplicate": 1, "short": 1, "empty": 1}
    assert (report["dedup_count"], report["removed_short"], report["removed_empty"], report["encoding_fixes"]) == (1, 1, 1, 1)


def test_empty_input(docs, spark):
    nothing = docs(["x"]).where("doc_id < 0")
    assert cl.clean_report(nothing).first()["final_count"] == 0
    assert score_quality(nothing).first()["overall"] == 0.0


def test_hot_text_merges_before_the_shuffle(docs):
    texts = ["hot text of all"] * 300 + [f"text number {i}" for i in range(20)]
    result = drop_exact_duplicates(docs(texts, 8))
    assert min(r["doc_id"] for r in result.collect()) == 0 and result.count() == 21
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_known_texts_go(docs):
    assert kept(drop_known(docs(["a", "b", "c"]), docs(["b"]))) == {0: "a", 2: "c"}


def test_quality(docs):
    row = score_quality(docs(["a chunk of text that repeats"] * 2 + ["another chunk of text here"])).first()
    assert row["duplicate_ratio"] == pytest.approx(1 / 3) and row["noise_ratio"] == 0
    clean = score_quality(docs(["First chunk of good text " * 20, "Second chunk of good text " * 20])).first()
    assert clean["duplicate_ratio"] == 0 and clean["overall"] > 0.5


def test_noise_counts_short_and_blank_texts(docs):
    row = score_quality(docs(["too short", "a" + " " * 40 + "b", "a plain sentence that is long enough"])).first()
    assert row["noise_ratio"] == pytest.approx(2 / 3)


def test_white_space_is_python_white_space(spark):
    every = "".join(chr(c) for c in range(1, 0x3100) if chr(c).isspace())
    assert one(spark, every + "a" + every, strip) == "a"
    assert one(spark, f"B{every}c", tokens) == ["b", "c"]
