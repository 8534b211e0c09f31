import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.numbers import fixed, round_half_even
from corpusmill import sinks
from corpusmill.operators import consistency, experiments, latency, metrics, verdicts
from corpusmill.session import scratch_path
from corpusmill.streaming import streams


def samples(spark, predictions, references, baselines=None, model="m"):
    rows = [
        (model, i, p, r, (baselines or predictions)[i]) for i, (p, r) in enumerate(zip(predictions, references))
    ]
    return spark.createDataFrame(rows, "model_id string, sample_id int, prediction string, reference string, baseline string").repartition(3)


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_qa(spark):
    row = metrics.qa_metrics(samples(spark, ["Paris", " berlin\n", "wrong"], ["Paris", "Berlin", "London"])).first()
    assert row["exact_match"] == pytest.approx(2 / 3) and row["f1"] == pytest.approx(2 / 3)
    assert metrics.exact_match(samples(spark, ["a"] + ["b"] * 48, ["a"] * 49)).first()["correct"] == 1


def test_token_f1_counts_repeats(spark):
    worked = {("a a b", "a b b"): 2 / 3, ("", ""): 1, ("", "x"): 0, ("x y", ""): 0, ("The cat", "the CAT sat"): 4 / 5, ("u v", "w"): 0, ("b b b a", "b"): 2 / 5, (None, "x"): 0, ("x", None): 0}
    pairs = list(worked)
    rows = samples(spark, *zip(*pairs)).select("sample_id", metrics.token_f1("prediction", "reference").alias("f"))
    assert {r["sample_id"]: pytest.approx(r["f"]) for r in rows.collect()} == dict(enumerate(worked.values()))


def test_classification(spark):
    rows = samples(spark, ["positive", "negative", "positive", "neutral"], ["positive", "negative", "negative", "neutral"])
    row = metrics.classification_metrics(rows).first()
    assert row["accuracy"] == 0.75
    precision, recall = (0.5 + 1 + 1) / 3, (1 + 0.5 + 1) / 3
    assert row["precision"] == pytest.approx(precision) and row["recall"] == pytest.approx(recall)
    assert row["f1"] == pytest.approx(2 * precision * recall / (precision + recall))


def test_missing_sides_are_misses(spark):
    rows = samples(spark, ["x y", "a", None, "a"], ["x y", None, "b", "a"], baselines=[None, "a", "b", "a"])
    exact, qa, faith = metrics.exact_match(rows).first(), metrics.qa_metrics(rows).first(), metrics.faithfulness(rows).first()
    assert (exact["exact_match"], exact["total_samples"], exact["correct"]) == (0.5, 4, 2)
    assert (qa["exact_match"], qa["f1"]) == (0.5, 0.5)
    assert (faith["faithfulness"], faith["hallucination_rate"], faith["flagged"]) == (0.5, 0.5, 2)
    classes = metrics.classification_metrics(rows).first()
    assert classes["accuracy"] == 0.5 and classes["recall"] == pytest.approx(2 / 3) and classes["precision"] == pytest.approx((1 + 0.5) / 3)
    assert {r["sample_id"] for r in metrics.correctness(rows).where("not correct").collect()} == {1, 2}
    assert [r["winner"] for r in metrics.compare_samples(rows).orderBy("sample_id").collect()] == ["finetuned", "tie", "baseline", "tie"]
    report = verdicts.validation_report(rows.drop("baseline")).first()
    assert (report["exact_match"], report["f1"], report["faithfulness"], report["hallucination_rate"]) == (0.5, 0.5, 0.5, 0.5)


def test_label_only_predicted_does_not_count(spark):
    row = metrics.classification_metrics(samples(spark, ["c", "b"], ["a", "b"])).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.5, 0.5, 0.5)


def test_comparison(spark):
    rows = samples(
        spark,
        ["Paris", "Berlin", "Tokyo", "London", "Rome"],
        ["Paris", "Berlin", "Tokyo", "Madrid", "Rome"],
        ["Paris", "wrong", "Tokyo", "wrong", "wrong"],
    )
    assert tuple(metrics.win_loss(rows).first())[1:] == (2, 0, 3)


@pytest.mark.parametrize("base, tuned, change", [(0.6, 0.8, 33.33), (0.0, 0.5, math.inf), (0.0, 0.0, 0.0), (0.5, 0.25, -50.0)])
def test_improvement(spark, base, tuned, change):
    schema = "model_id string, metric string, value double"
    found = metrics.improvement(
        spark.createDataFrame([("m", "f1", tuned), ("m", "new", 1.0)], schema), spark.createDataFrame([("m", "f1", base)], schema)
    ).collect()
    assert [r["improvement_pct"] for r in found] == [change]


def test_faithfulness_and_flags(spark):
    rows = samples(spark, ["capital of Germany", "xyz abc", "same words"], ["capital of France", "nothing like it", "same words"])
    row = metrics.faithfulness(rows).first()
    assert row["faithfulness"] == pytest.approx((0.5 + 0 + 1) / 3) and row["hallucination_rate"] == pytest.approx(1 / 3)
    assert [(r["sample_id"], r["overlap"]) for r in metrics.hallucinations(rows).collect()] == [(1, 0.0)]


def test_alignment(spark):
    left = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "model_id string, sample_id int")
    right = spark.createDataFrame([(1, "a"), (3, "b")], "sample_id int, reference string")
    assert tuple(metrics.alignment_report(metrics.align(left, right)).first())[1:] == (3, 2, 1)


def responses(spark, groups):
    rows = [("m", p, i, text) for p, texts in enumerate(groups) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "model_id string, prompt_id int, response_idx int, response string").repartition(4)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_self_consistency_in_blocks(spark, block):
    rng = random.Random(3)
    words = "red green blue black white grey".split()
    groups = [[" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(n)] for n in (1, 2, 7, 40)] + [["same a"] * 30]
    expected = {}
    for p, texts in enumerate(groups):
        pairs = [jaccard(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
        expected[p] = pytest.approx(sum(pairs) / len(pairs) if pairs else 1.0)
    scores = consistency.self_consistency(responses(spark, groups), block=block)
    assert {r["prompt_id"]: r["consistency"] for r in scores.collect()} == expected
    assert {r["prompt_id"]: r["responses"] for r in scores.collect()} == {p: len(t) for p, t in enumerate(groups)}


def test_exact_consistency_and_flags(spark):
    groups = [["Paris", " paris", "PARIS "], ["Paris", "London", "Berlin"], ["alone"], ["a", "a", "b", "b"]]
    scores = consistency.exact_consistency(responses(spark, groups))
    assert {r["prompt_id"]: r["consistency"] for r in scores.collect()} == {0: 1.0, 1: 0.0, 2: 1.0, 3: pytest.approx(2 / 6)}
    assert {r["prompt_id"] for r in consistency.divergent_prompts(scores).collect()} == {1, 3}


@pytest.mark.parametrize(
    "values, expected",
    [
        ([100, 120, 130, 150, 200, 250, 300, 350, 400, 500], (225.0, 455.0, 491.0, 250.0)),
        ([7.25], (7.25, 7.25, 7.25, 7.25)),
        ([-5.0, 0.0, 5.0, 5.0, 5.0], (5.0, 5.0, 5.0, 2.0)),
    ],
)
def test_latency(spark, values, expected):
    rows = spark.createDataFrame([("m", float(v)) for v in values], "model_id string, duration_ms double").repartition(3)
    row = latency.latency_stats(rows).first()
    assert (row["p50_ms"], row["p95_ms"], row["p99_ms"], row["mean_ms"]) == expected


def test_latency_on_many_values(spark):
    rng = random.Random(5)
    values = sorted(round(rng.lognormvariate(3, 2), 4) for _ in range(2000))
    rows = spark.createDataFrame([("m", v) for v in values], "model_id string, duration_ms double").repartition(5)
    row = latency.latency_stats(rows).first()
    for name, p in latency.PERCENTILES.items():
        k = p * (len(values) - 1)
        low = int(k)
        assert row[name] == round(values[low] + (k - low) * (values[low + 1] - values[low]), 2)


@pytest.mark.parametrize(
    "kind, output, ok",
    [
        ("json", '{"a": 1}', True), ("json", "not json at all", False), ("json", "1 2", False), ("json", "NaN", True),
        (" JSON ", "[1]", True), ("list", "- one", True), ("list", "* x", True), ("list", "a\nb", True), ("list", " a \n", False),
        ("text", "words", True), ("text", " \n", False), ("other", "x", True), ("json", None, False),
    ],
)
def test_format_compliance(spark, kind, output, ok):
    rows = spark.createDataFrame([("m", kind, output)], "model_id string, expected_format string, output string")
    assert metrics.format_compliance(rows).first()["format_compliance"] == float(ok)


def test_responses_by_model(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "prompt_id int, model_id string, response string")
    found = {r["prompt_id"]: (r["a"], r["b"]) for r in metrics.responses_by_model(rows, ["a", "b"]).collect()}
    assert found == {1: ("x", "y"), 2: ("z", None)}


@pytest.mark.parametrize(
    "values, grade",
    [
        ({"exact_match": 0.9, "f1": 0.8}, "A"), ({"exact_match": 0.9, "f1": 0.6}, "C"), ({"exact_match": 0.1, "f1": 0.9}, "F"),
        ({"other": 0.7}, "B"), ({"other": 0.1, "more": 0.2}, "F"), ({"accuracy": 0.1, "f1": 0.75}, "A"),
    ],
)
def test_metric_grades(spark, values, grade):
    rows = spark.createDataFrame([("m", k, v) for k, v in values.items()], "model_id string, metric string, value double")
    assert verdicts.grade_metrics(rows).first()["benchmark_grade"] == grade


@pytest.mark.parametrize(
    "benchmark, rate, gain, grade",
    [("A", 0.03, 25.0, "A"), ("C", 0.08, 10.0, "C"), ("F", 0.35, -5.0, "F"), ("A", 0.03, None, "A"), ("A", 0.2, None, "C")],
)
def test_overall_grade(spark, benchmark, rate, gain, grade):
    row = spark.createDataFrame([(benchmark, rate, gain)], "b string, r double, g double")
    judged = row.select(
        verdicts.overall_grade(F.col("b"), F.col("r"), F.col("g")).alias("o"),
    ).first()["o"]
    assert judged == grade


def test_report(spark):
    rows = samples(
        spark,
        ["Paris", "Berlin", "Tokyo", "London", "Rome"],
        ["Paris", "Berlin", "Tokyo", "Madrid", "Rome"],
        ["Paris", "wrong", "Tokyo", "wrong", "wrong"],
    )
    row = verdicts.validation_report(rows).first()
    assert row["exact_match"] == 0.8 and (row["wins"], row["losses"], row["ties"]) == (2, 0, 3)
    assert row["improvement_pct"] == pytest.approx(100.0) and row["benchmark_grade"] == "A" and row["overall_grade"] == "B"  # (4 + 0 + 4) / 3
    assert row["summary"] == (
        "Overall grade: B. Benchmark grade: A. Hallucination rate: 20.00%. Improvement over baseline: 100.0%. "
        "Model is recommended for production deployment."
    )
    alone = verdicts.validation_report(rows.drop("baseline"), task_type=None).first()
    assert alone["task_type"] == "classification" and alone["improvement_pct"] is None
    assert "No baseline comparison performed." in alone["summary"]


def runs(spark, rows):
    return spark.createDataFrame(
        [("c", i, f"exp-{i + 1}", loss, loss is None) for i, loss in enumerate(rows)],
        "campaign_id string, idx long, experiment_id string, final_loss double, failed boolean",
    ).repartition(3)


@pytest.mark.parametrize("segment", [1, 2, 1000])
@pytest.mark.parametrize(
    "losses, expected",
    [
        ([1.245, 1.231, 1.258, None, 1.231, 1.2], ["baseline", "improved", "regressed", "failed", "regressed", "improved"]),
        ([None, 1.0, 0.5], ["failed", "regressed", "regressed"]),
    ],
)
def test_run_status(spark, segment, losses, expected):
    labelled = experiments.label_runs(runs(spark, losses), segment=segment)
    assert [r["status"] for r in labelled.orderBy("idx").collect()] == expected


def test_best_run_and_summary(spark):
    labelled = experiments.label_runs(runs(spark, [1.245, 1.231, 1.258, None, 1.231]))
    assert experiments.best_runs(labelled).first()["experiment_id"] == "exp-2"
    row = experiments.summarize_runs(labelled).first()
    assert tuple(row)[1:] == (5, 1, 2, 1, 1.231, "exp-2")


def test_bits_per_byte(spark):
    rows = spark.createDataFrame([("a", 1.0, 4), ("a", 2.0, 4), ("a", 1.5, 2), ("b", 1.0, 0)], "k string, loss_nats double, n_bytes int")
    found = {r["k"]: r["bpb"] for r in experiments.bits_per_byte(rows, by=["k"]).collect()}
    assert found == {"a": pytest.approx(4.5 / (math.log(2) * 10)), "b": math.inf}


@pytest.mark.parametrize("value", [2.675, 0.125, 1.005, -2.5, 1234567.895, 0.0, 1e-9, math.inf])
def test_rounding_is_python_rounding(spark, value):
    row = spark.createDataFrame([(value,)], "x double").select(
        round_half_even(F.col("x"), 2).alias("r"), fixed(F.col("x"), 1).alias("t")
    ).first()
    assert row["r"] == (value if math.isinf(value) else round(value, 2))
    assert row["t"].replace("-0.0", "0.0") == f"{value:.1f}".replace("-0.0", "0.0")


def test_index_writes_can_be_repeated(spark, tmp_path):
    from corpusmill import sinks

    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "chunk_id string, norm double")
    second = spark.createDataFrame([("b", 5.0), ("c", 3.0)], "chunk_id string, norm double")
    path = str(tmp_path / "index")
    for run, rows in (("1", first), ("1", first), ("2", second), ("2", second)):
        sinks.write_index(rows, path, run=run)
    sinks.write_index(first, path, collection="other")
    assert sorted(map(tuple, sinks.read_index(spark, path).select("chunk_id", "norm").collect())) == [("a", 1.0), ("b", 5.0), ("c", 3.0)]


def test_generation_metrics(spark):
    from corpusmill.functions.overlaps import clipped, common_subsequence

    rng = random.Random(4)

    def plain_subsequence(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            line = [0] + [max(m, 0) for m in _row(x, b, line)]
        return line[-1]

    def _row(x, b, line):
        out = []
        for j, y in enumerate(b):
            out.append(max(line[j + 1], line[j] + (x == y), out[-1] if out else 0))
        return out

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert common_subsequence(a, b) == plain_subsequence(a, b)
        for n in (1, 2, 3):
            runs = [[tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (a, b)]
            assert clipped(a, b, n) == sum(min(runs[0].count(g), runs[1].count(g)) for g in set(runs[0]))
    rows = [
        ("m", "the cat sat on the mat today", "the cat sat on the red mat"), ("m", None, "two words"), ("m", "Five words are written here", None), ("m", "", " "),
        ("short", "the cat sat on", "the cat sat on the mat"), ("none", "x y z", "the cat"), ("empty", None, None),
    ]
    found = {r["model_id"]: tuple(r)[1:] for r in metrics.generation_metrics(spark.createDataFrame(rows, "model_id string, prediction string, reference string")).collect()}
    shared, runs, given, wanted = (6, 4, 3, 2), (12, 10, 8, 6), 12, 9
    bleu = math.exp(sum(math.log(s / t) for s, t in zip(shared, runs)) / 4 + min(0, 1 - wanted / given))
    assert found["m"] == pytest.approx((bleu, (2 * 6 / 14 + 1) / 4, (2 * 6 / 14 + 1) / 4))
    assert found["short"] == pytest.approx((math.exp(1 - 6 / 4), 8 / 10, 8 / 10))
    assert found["none"] == (0.0, 0.0, 0.0) and found["empty"] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("sparse", [consistency.SPARSE, 0.0, 1e9])
def test_self_consistency_of_many_answers(spark, sparse):
    """Prompts of very many different answers, most of them without a common word, and one where all share words."""
    rng = random.Random(3)
    rows = [("m", "thin", " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(0, 6)))) for _ in range(700)]
    rows += [("m", "thick", "the answer is " + str(rng.randrange(90))) for _ in range(150)]
    rows += [("m", "apart", f"own{k}") for k in range(80)] + [("m", "few", "a b"), ("m", "few", "b c"), ("m", "one", "x")]
    frame = spark.createDataFrame(rows, "model_id string, prompt_id string, response string").repartition(3)
    found = {r["prompt_id"]: r["consistency"] for r in consistency.self_consistency(frame, sparse=sparse).collect()}
    for prompt in ("thin", "thick", "apart", "few", "one"):
        answers = [t for _, p, t in rows if p == prompt]
        scores = [jaccard(a, b) for i, a in enumerate(answers) for b in answers[i + 1 :]]
        assert found[prompt] == pytest.approx(sum(scores) / len(scores) if scores else 1.0, abs=1e-12)


def test_index_snapshots(spark):
    path = scratch_path(spark, "index-test")
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, norm double").repartition(2)
    shown = lambda **at: sorted(map(tuple, sinks.read_index(spark, path, **at).select("chunk_id", "norm").collect()))
    sinks.write_index(frame([("a", 1.0), ("b", 2.0)]), path)
    sinks.write_index(frame([("c", 3.0)]), path)
    assert shown() == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    sinks.write_index(frame([("b", 5.0), ("d", 4.0)]), path, run="10")
    sinks.delete_from_index(frame([("a", 0.0), ("zz", 0.0)]), path, run="9")
    assert shown() == [("b", 5.0), ("c", 3.0), ("d", 4.0)]
    sinks.write_index(frame([("b", 5.0), ("d", 4.0)]), path, run="10")  # a retry changes nothing
    sinks.delete_from_index(frame([("a", 0.0), ("zz", 0.0)]), path, run="9")
    assert shown() == [("b", 5.0), ("c", 3.0), ("d", 4.0)]
    sinks.write_index(frame([("a", 7.0)]), path, run="1")
    assert shown() == [("a", 7.0), ("b", 5.0), ("c", 3.0), ("d", 4.0)]
    assert shown(snapshot=2) == [("a", 1.0), ("b", 2.0), ("c", 3.0)] and shown(snapshot=3) == [("a", 1.0), ("b", 5.0), ("c", 3.0), ("d", 4.0)]
    assert [r["snapshot"] for r in sinks.index_snapshots(spark, path).collect()] == [1, 2, 3, 4, 5]


def test_quality_parts_merge(spark):
    """Parts of any batches give the quality of all rows; the sketch stays within four standard errors."""
    rows = [(f"2024-01-01 0{i % 2}:{i % 60:02d}:00", "en" if i % 5 else None, f"A text with some words in it, number {i % 7000}.") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "ts string, lang string, content string")
    parts = [streams.quality_parts(frame.where(F.pmod(F.xxhash64("content", "ts"), F.lit(3)) == k), time="ts", width="1 hour", by=["lang"]) for k in range(3)]
    sums, digests = (parts[0][j].unionByName(parts[1][j]).unionByName(parts[2][j]) for j in (0, 1))
    found = {(str(r["window_start"])[11:13], r["lang"]): r for r in streams.merged_quality(sums, digests, by=["lang"]).collect()}
    assert len(found) == 4
    for (hour, lang), r in found.items():
        held = [t for ts, g, t in rows if ts[11:13] == hour and g == lang]
        assert (r["total_chunks"], r["unique_chunks"]) == (len(held), len(set(held)))
        assert abs(r["estimated_chunks"] / len(set(held)) - 1) < 4 * 0.0082
        assert r["duplicate_ratio"] == pytest.approx(1 - len(set(held)) / len(held)) and r["noise_ratio"] == 0.0
        assert r["coverage"] == pytest.approx(sum(map(len, held)) / len(held) / 500)
