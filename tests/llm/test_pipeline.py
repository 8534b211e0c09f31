"""The pipeline's stages against plain versions, each on what the stage before it kept."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from test_operators import TEXTS, copies, plain_components, plain_measures, prose

import corpus_pipeline
from corpusmill.llm import decontaminate, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NOTICE = prose(41, 70).replace("\n", " ")
PASSAGE = prose(42, 45)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    def line(text):  # one-word lines of the made-up prose recur by chance
        return text and text.replace("\n", " ")

    texts = [*map(line, TEXTS), *map(line, copies()), *(f"{line(prose(700 + k, 40))}\n{NOTICE}\n{line(prose(800 + k, 40))}" for k in range(9))]
    texts += [line(prose(900, 60) + " " + PASSAGE.upper() + " " + prose(901, 60)), "| menu | " * 40 + prose(902, 5)]
    rows = [(i, t, "xx", "s", len(t) if t else None) for i, t in enumerate(texts)] + [(None, prose(903, 40), "xx", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, prose(43, 45))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def results(spark, tables, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, tables).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns(results):
    assert all(frame.columns == COLUMNS for frame in results[:-1])


def test_quality_stage(spark, tables, results):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.judge(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    want = {i: t for i, t in texts_of(docs).items() if i is not None and not plain_measures(t)[-1] and score[i] >= quality.MIN_SCORE}
    assert texts_of(results[0]) == want and len(want) > 150


def test_line_stage(results):
    before, after = texts_of(results[0]), texts_of(results[1])
    noticed = {i for i, t in before.items() if NOTICE in t.split("\n")}
    assert len(noticed) >= 5 and before.keys() == after.keys()
    assert {i for i in before if before[i] != after[i]} == noticed
    assert all(after[i] == "\n".join(x for x in before[i].split("\n") if x != NOTICE) for i in before)
    assert all(r["n_chars"] == len(r["text"]) for r in results[1].collect())


def test_near_stage(results):
    before, after = texts_of(results[1]), texts_of(results[2])
    kept = {i for i, (_, root) in plain_components(sorted(before.items()), 5, 80).items() if i == root}
    assert after == {i: before[i] for i in kept} and len(after) < len(before)


def test_benchmark_stage(results):
    before, after = texts_of(results[2]), texts_of(results[3])
    held = {i for i, t in before.items() if decontaminate.normal(PASSAGE) in decontaminate.normal(t)}
    assert after == {i: t for i, t in before.items() if i not in held} and len(held) == 1


def test_packing_stage(results):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, t in texts_of(results[3]).items():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    rows = results[4].collect()
    assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in rows} == want
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(total / 2048) + 1


def test_run(spark, tables, results):
    def rows(frame):
        return sorted(tuple(r) for r in frame.drop("sequence_id", "offset").collect())

    assert rows(corpus_pipeline.run(spark, tables)) == rows(results[4])
