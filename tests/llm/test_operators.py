"""Each training-data operator against a plain version, on texts with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import time
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import components, decontaminate, html_extract, licenses, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, token_files, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "ka lo mi nu pe ra so tu vé xi".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


LONG = prose(5, 4000)
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "Ein Wort  mehr\t\tund é ́ Σας 日本語 <|endoftext|>",
    prose(1, 300),
    prose(1, 300),
    prose(1, 300).upper(),
    prose(1, 200) + " changed " + prose(2, 100),
    prose(3, 60) + "\n" + prose(4, 80),
    prose(6, 50) + prose(4, 80) + "\n" + prose(4, 80),
    LONG,
    LONG[:9000] + "x" + LONG[9000:],
    "abc" * 200,
    "same few words here again and again " * 20,
    "Licensed under the Apache License, Version 2.0.\n" + prose(7, 40),
    "All rights reserved. CC BY, cc-by; General Public LICENSE",
    *[prose(100 + k, 30) for k in range(20)],
]
#: Names that the operators use for columns of their own.
CLASHES = "bucket key data row n tokens leaf family length shard size slot _row _id _tokens _uni gram score kept a b".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *range(len(CLASHES))) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0, 5) for i in range(18, 30)] + [(None, 1, 0, 5), (6, 1, None, 5), (7, None, 1, 5), (9, 0, 0, 5)], "doc_id long, quality int, toxic int, weight int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(0, prose(4, 40)), (1, None), (2, ""), (3, "xi"), (4, prose(999, 50)), (5, prose(4, 40)), (None, prose(3, 40)), (6, LONG[2000:3500])]
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_id int")


def by_id(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


# 1 -----------------------------------------------------------------------------------------------


def plain_repeats(texts):
    seen, out = {}, {}
    for i, t in texts:
        data, gone = (t or "").encode(), set()
        for p in range(len(data) - 99):
            if seen.setdefault(data[p : p + 100], (i, p)) != (i, p):
                gone.update(range(p, p + 100))
        kept = bytes(b for p, b in enumerate(data) if p not in gone)
        spans = sum(p - 1 not in gone for p in gone)
        out[i] = (len(data), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CELLS", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == plain_repeats(enumerate(TEXTS))


def test_suffix_dedup_repeated_rows_and_none(docs, none):
    twice = docs.where("doc_id in (6, 10)").unionByName(docs.where("doc_id = 6"))
    rows = suffix_dedup.remove_repeats(twice).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(6, 0), (6, 0), (10, 0)]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 300, dtype=np.uint8)
    width = 12
    suffixes = np.lib.stride_tricks.sliding_window_view(text, width)
    positions = rng.permutation(len(suffixes))
    got = suffix_dedup.longest_previous(suffixes.copy(), positions)
    for i in range(len(suffixes)):
        shared = [next((k for k in range(width) if suffixes[i][k] != suffixes[j][k]), width) for j in range(len(suffixes)) if positions[j] < positions[i]]
        assert got[i] == max(shared, default=0)


def test_bucket_of_agrees_with_spark(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, -1, 12345678901234, -(1 << 63))], "x long").select("x", F.pmod(F.xxhash64("x"), F.lit(97)).alias("b")).collect()
    assert suffix_dedup.bucket_of(np.array([r["x"] for r in rows]), 97).tolist() == [r["b"] for r in rows]


# 2 and 5 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_tokenizer(name, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 150)
    monkeypatch.setattr(tokens, "PRE_TOKENS", 100)
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(" \n\t'saré,.12Z ́\x1c\xa0　", k=rng.randint(0, 30))) for _ in range(800)]
    code = tokens.Encoder(public_tokenizers.path(name), spaced=spaced)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(code.encode(texts)) == want


def test_encoder_looks_up_each_piece_once():
    """Also pieces for which there is no room in the cache: once for the texts that are encoded together, not at every place."""
    code = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), spaced=False)
    asked, piece = [], code._piece
    code.pieces = tokens._Pieces(lambda p: asked.append(p) or piece(p), 0)
    texts = ["one two two", None, "two Èa. two"]
    assert list(code.encode(texts)) == [code._direct(t or "") for t in texts]
    assert sorted(asked) == ["one", "two", "Èa."]



def test_encoder_keeps_a_plain_word_once():
    """A word without a mark is a piece already; with a mark, it takes the ids from there."""
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        code = tokens.Encoder(public_tokenizers.path(name), spaced=spaced)
        texts = ["a one two Été", "a one, two. été! three; ONE"]
        assert list(code.encode(texts)) == [code._direct(t) for t in texts]
        assert {t.strip() for t in code.tokens} & {"one", "two", "three", "Été", "été"} == {"three", "été"} - ({"été"} if not spaced and "été" in code.pieces else set())


def plain_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, 0], dtype="<u4") for e in t.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_packing(docs, none):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = {}
    for i, ids in enumerate(plain_ids("word_bpe_49k.json")):
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= math.ceil(sum(n for _, n, _ in want.values()) / 2048) + 1
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_plan():
    rng = random.Random(1)
    for _ in range(30):
        capacity = rng.choice([10, 50, 200])
        histogram = {length: rng.randint(1, 40) for length in rng.sample(range(1, capacity + 1), 9)}
        bins = packing.plan(histogram, capacity)
        used = collections.Counter()
        for lengths, times in bins:
            assert sum(lengths) <= capacity and times > 0
            for length in lengths:
                used[length] += times
        assert used == histogram
        first_fit = []
        for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            k = next((k for k, room in enumerate(first_fit) if room >= length), None)
            if k is None:
                first_fit.append(capacity - length)
            else:
                first_fit[k] -= length
        assert sum(t for _, t in bins) <= len(first_fit) + 1
    assert packing.plan({70: 1, 20: 1, 7: 1, 3: 1}, 100) == [((70, 20, 7), 1), ((3,), 1)] or sum(t for _, t in packing.plan({70: 1, 20: 1, 10: 1}, 100)) == 1


def test_token_files(docs, none, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    got = by_id(token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257))
    start = 0
    for i, ids in enumerate(plain_ids("byte_bpe_50k.json")):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(TEXTS)
    assert token_files.token_files(none, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257).count() == 0


def test_folder_has_the_scheme_that_spark_gives(spark, tmp_path):
    assert token_files.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert token_files.qualified(spark, f"file://{tmp_path}").startswith("file:/")
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert token_files.file_system(uri)[1] == str(tmp_path)


def test_shard_select(tmp_path):
    rng = random.Random(4)
    ids = [np.array(rng.choices(range(60_000), k=rng.choice([0, 1, 5, 700])), dtype="<u4").tobytes() for _ in range(900)]
    keys = sorted(rng.sample(range(-(10**12), 10**15), 899)) + [10**15]
    token_files.write_shard(str(tmp_path), "s", keys, ids, 2)
    shard = token_files.Shard(str(tmp_path), "s")
    assert len(shard) == 900 and [k for k, _, _ in shard.documents()] == keys
    for i in (0, 1, 255, 256, 257, 511, 899):
        key, start, found = shard.document(i)
        assert (key, found.tobytes(), start) == (keys[i], ids[i], sum(map(len, ids[:i])) // 4)
    values = np.cumsum([rng.randint(0, 1000) for _ in range(5000)])
    coded = token_files.EliasFano.encode(values)
    assert coded.all().tolist() == values.tolist() and [coded.select(i) for i in range(0, 5000, 97)] == values[::97].tolist()
    assert len(coded.to_bytes()) < 5000 * 2


# 3 -----------------------------------------------------------------------------------------------


def plain_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies():
    rng, out = random.Random(9), []
    for group in range(6):
        base = prose(500 + group, 120).split()
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(SYLLABLES) * 3
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("width", "percent", "most"), [(3, 85, 3_000), (5, 80, 3_000), (3, 85, 10)])
def test_near_dedup(spark, docs, none, monkeypatch, width, percent, most):
    monkeypatch.setattr(near_dedup, "FAMILY_SETS", most)
    texts = TEXTS + copies()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component", F.lit(1)).repartition(4)
    got = by_id(near_dedup.near_duplicates(frame, width=width, percent=percent))
    want = plain_components(enumerate(texts), width, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def changed(words, start, n, mark):
    return words[:start] + [f"{mark}y{k}" for k in range(n)] + words[start + n :]


def test_near_dedup_pairs_in_a_large_family(spark, monkeypatch):
    """Pairs of similarity 0.82 whose texts share half of their shingles with all others, so that all are one family."""
    monkeypatch.setattr(near_dedup, "FAMILY_SETS", 20)
    base, texts = [f"w{k}" for k in range(300)], []
    for i in range(150):
        own = changed(base, 0, 100, f"a{i}")
        texts += [" ".join(own), " ".join(changed(own, 150, 25, f"b{i}"))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(near_dedup.near_duplicates(frame, width=5, percent=80))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_components(enumerate(texts), 5, 80)
    assert all(r["component_id"] == i - i % 2 for i, r in got.items())


def test_near_dedup_region_beyond_a_task(spark, monkeypatch):
    """Texts that differ in one word each stay together at any depth; no task compares many more sets than the bound."""
    monkeypatch.setattr(near_dedup, "FAMILY_SETS", 20)
    large, link = spark.sparkContext.accumulator(0), near_dedup.link

    def watched(sets, percent):
        large.add(len(sets) > 60)
        return link(sets, percent)

    monkeypatch.setattr(near_dedup, "link", watched)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(changed(base, i % 300, 1, f"a{i}")) for i in range(400)]
    texts += [" ".join(changed(base, 0, 40 + k, f"b{k}")) for k in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(near_dedup.near_duplicates(frame, width=5, percent=80))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_components(enumerate(texts), 5, 80)
    assert large.value == 0


def plain_prefix(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


def tasks_run(spark, label, work):
    """Tasks that ``work`` runs under 64 shuffle partitions that are not joined."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(label, label)
    try:
        result = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(label) for s in tracker.getJobInfo(j).stageIds]
    return result, sum(i.numCompletedTasks for i in infos if i)


@pytest.mark.parametrize("most", [50_000, 40])
def test_components_take_tasks_by_their_edges(spark, monkeypatch, most):
    """A few edges need few tasks in every round, however many the shuffle partitions are; more edges than a task's are dealt out."""
    monkeypatch.setattr(components, "EDGES_PER_TASK", most)
    edges = [(k + 1, k) for k in range(60)] + [(100, k) for k in range(100, 180)] + [(205, 204), (204, 205), (300, 300)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found, ran = tasks_run(spark, f"components-{most}", lambda: {r["node"]: r["root"] for r in components.components(frame).collect()})
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 180)}, 204: 204, 205: 204}
    assert most < 100 or 0 < ran < 6 * 64


def test_line_levels_take_tasks_by_their_tokens(spark, monkeypatch):
    """Levels of few lines need few tasks, and lines dealt out to more tasks get the same templates."""
    pairs = [(w, v) for w in "pqrs" for v in "klm"]
    alone = lambda w, v: "\n".join(f"{a}{w}{v} {b} alone" for a in "abc" for b in "de")
    texts = [f"open the door of room {w} in the old {v} house again today\n{'left' if w < 'r' else 'right'} the gate of\n{alone(w, v)}" for w, v in pairs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    run = lambda: sorted(map(tuple, line_dedup.recurring_lines(docs).collect()))
    found, ran = tasks_run(spark, "lines", run)
    assert {n for _, n in found} == {0, 1} and 0 < ran < 40 * 64
    monkeypatch.setattr(line_dedup, "TOKENS_PER_TASK", 60)
    assert run() == found


def test_forest_orders_and_depths(spark, monkeypatch):
    """Runs of sorted orders equal the sets that agree in DEPTH values; neighbours are next in order; crowded regions are read as deep as it takes."""
    monkeypatch.setattr(near_dedup, "FAMILY_SETS", 4)
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (60, near_dedup.TREES * near_dedup.STRIDE))
    rows[30:] = rows[:30]
    rows[np.arange(30, 60), rng.integers(0, rows.shape[1], 30)] ^= 1
    wide = np.hstack([rows, rows[:, : near_dedup.DEEPEST]])
    reps = spark.createDataFrame([(i, 10, bytearray(r.astype(near_dedup.VALUE).tobytes())) for i, r in enumerate(wide)], "doc_id long, n_shingles long, signature binary")
    reps = reps.repartition(3)
    codes = {(i, t): tuple(wide[i, t * near_dedup.STRIDE :][: near_dedup.DEEPEST]) for i in range(60) for t in range(near_dedup.TREES)}
    shared = {}
    for (i, t), code in codes.items():
        shared.setdefault((t, code[: near_dedup.DEPTH]), []).append(i)

    found = near_dedup._neighbours(reps).collect()
    inside = [r for r in found if r["border"] is None]
    borders = sum(r["border"] is not None for r in found)
    assert sum(len(v) - 1 for v in shared.values()) - borders <= len(inside) <= sum(len(v) - 1 for v in shared.values())
    assert all(any(plain_prefix(codes[r["a"], t], codes[r["other"], t]) == r["common"] for t in range(near_dedup.TREES)) for r in inside)
    root = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame([(v[0], x) for v in shared.values() for x in v[1:]], "a long, b long")).collect()}
    assert {r["doc_id"]: r["family"] for r in near_dedup._families(reps, near_dedup._neighbours(reps)).collect()} == root

    every, parts = near_dedup._regions(near_dedup._orders(reps))
    assert every.count() == sum(len(v) for v in shared.values() if len(v) > 1)
    want = set()
    for crowd in (v for v in shared.items() if len(v[1]) > 4):
        (tree, _), members = crowd
        for i in members:
            for depth in range(near_dedup.DEPTH + 1, near_dedup.DEEPEST + 1):
                same = tuple(sorted(j for j in members if codes[j, tree][:depth] == codes[i, tree][:depth]))
                if len(same) <= 4:
                    want |= {same} if len(same) > 1 else set()
                    break
    got = {}
    for r in parts.collect():
        got.setdefault(r["region"], []).append(r["doc_id"])
    assert {tuple(sorted(v)) for v in got.values()} == want and want


def test_near_dedup_none_and_repeats(docs, none):
    assert near_dedup.near_duplicates(none).count() == 0
    twice = docs.where("doc_id = 6").unionByName(docs.where("doc_id in (6, 7)"))
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(twice).collect()) == [(6, 6), (6, 6), (7, 6)]


# 4 -----------------------------------------------------------------------------------------------


def test_sharding(spark, none):
    rng = random.Random(3)
    texts = [prose(k, rng.randint(1, 60)) for k in range(700)] + ["one hot text that many rows have"] * 900 + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit(7)).repartition(3)
    rows = sharding.shard(frame, 8).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    held = collections.defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in held[s]) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * max(sizes)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in held.values())
    places = collections.defaultdict(set)
    for r in rows:
        places[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(s) == 1 for t, s in places.items() if not t.startswith("one hot"))
    assert sharding.shard(none).count() == 0


def test_sharding_of_a_hot_text_without_ids(spark):
    """Rows without doc_id and rows that repeat one are dealt out like others; a very long text is placed whole."""
    rows = [(None, "one hot text that many rows have")] * 4_000 + [(7, "another row that repeats")] * 3_000 + [(k, prose(k, 20)) for k in range(500)]
    frame = spark.createDataFrame([*rows, (900, "w " * 4_000)], "doc_id long, text string").repartition(4)
    out = sharding.shard(frame, 8).collect()
    assert len(out) == len(rows) + 1
    held = collections.defaultdict(list)
    for r in out:
        held[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in rs) for rs in held.values()]
    assert len(held) == 8 and max(sizes) < 1.05 * min(sizes)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in held.values())


# 6 -----------------------------------------------------------------------------------------------


def test_decontamination(docs, none, benchmark):
    rows = decontaminate.contaminated(docs, benchmark).collect()
    hit = {(r["doc_id"], r["item_id"]) for r in rows}
    passages = {0: prose(4, 40), 5: prose(4, 40)}
    plain = {(d, i) for d, t in enumerate(TEXTS) for i, p in passages.items() if t and decontaminate.normal(p) in decontaminate.normal(t)}
    plain |= {(d, 3) for d, t in enumerate(TEXTS) if t and "xi" in decontaminate.normal(t).split()}
    assert {h for h in hit if h[1] != 6} == plain and {(12, 6), (13, 6)} <= hit
    first = next(r for r in rows if (r["doc_id"], r["item_id"]) == (10, 0))
    assert decontaminate.normal(TEXTS[10][first["start"] : first["end"]]) == decontaminate.normal(passages[0])
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("item_id < 0")).count() == 0
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(TEXTS))) - {d for d, _ in hit}


def plain_distance(passage, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_alignment_and_filter():
    rng = random.Random(6)
    for _ in range(150):
        p = "".join(rng.choices("abc", k=rng.randint(3, 25)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 30))) + p[:9] + rng.choice(["", "a", "bb"]) + p[10:] + "".join(rng.choices("abc", k=rng.randint(0, 9)))
        found = decontaminate.align(decontaminate._codes(p), decontaminate._codes(t), 5, len(t) + 10)
        want = plain_distance(p, t)
        assert (found[0] if found else None) == (want if want <= 5 else None)
    index = decontaminate.Passages([(1, decontaminate.normal(prose(800, 45)))])
    passage = index.segments[0][1]
    for _ in range(60):  # as many edits as are allowed, anywhere
        letters = list(passage)
        for _ in range(decontaminate.edit_budget(len(passage))):
            k = rng.randrange(len(letters))
            letters[k : k + 1] = rng.choice([[], ["q"], [letters[k], "q"]])
        text = decontaminate.normal(prose(rng.randint(0, 99), 30) + " " + "".join(letters) + " " + prose(1, 9))
        assert [f[1] for f in index.search(decontaminate._codes(text), np.array([0]))]


def test_decontamination_of_neighbours(spark):
    """Short documents next to each other in one batch, with the same passage, whole or with an edit."""
    question = "how tall is the old tower of the town"
    texts = [question if k % 3 else question.replace("old", "odd") for k in range(60)] + [f"so {question}"] * 20 + ["tower of the town"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, question), (2, "the old tower of the town")], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["edits"]) for r in decontaminate.contaminated(frame, items).collect()}
    want = {(d, 1): (t.find("how"), len(t), int("odd" in t)) for d, t in enumerate(texts[:80])}
    assert {k: v for k, v in rows.items() if k[1] == 1} == want
    assert {d for d, i in rows if i == 2} == set(range(80))


# 7 -----------------------------------------------------------------------------------------------


def test_line_dedup(spark, none):
    notice = prose(77, 60).replace("\n", " ")
    texts = [f"{prose(k, 9).replace(chr(10), ' ')}\nPosted on 2024-0{k % 9 + 1}-11 by user{k}\n{notice}\n\n{prose(k + 50, 9).replace(chr(10), ' ')}" for k in range(12)]
    same = "\n".join(prose(300 + k, 9).replace("\n", " ") for k in range(8))
    texts += [same] * 30 + [None, "", "\n\n"]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, leaf int, n string").repartition(3)
    done = line_dedup.drop_recurring(frame)
    assert done.columns == [*frame.columns, "dedup"]
    got = by_id(done)
    for k in range(12):
        first, _, _, blank, last = texts[k].split("\n")
        assert got[k]["text"] == "\n".join([first, blank, last]) and tuple(got[k]["dedup"]) == (5, 2)
    assert all(got[i]["text"] == texts[i] for i in range(12, len(texts)))  # copies of one text are no recurring lines
    assert line_dedup.drop_recurring(none.select("doc_id", "text")).count() == 0


def test_line_dedup_among_copies(spark):
    """Copies of one of the documents that hold a notice do not keep it; a group of near copies alone keeps its lines."""
    line = lambda seed, n=9: prose(seed, n).replace("\n", " ")
    notice = line(78, 60)
    texts = ["\n".join([*(line(10_000 + 10 * k + j) for j in range(6)), notice]) for k in range(30)]
    texts += [texts[7]] * 100
    near = [line(20_000 + j) for j in range(20)]
    texts += ["\n".join([*near[: k % 20], line(30_000 + k), *near[k % 20 + 1 :]]) for k in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(line_dedup.drop_recurring(frame))
    assert {i: r["text"] for i, r in got.items()} == {i: t.removesuffix("\n" + notice) for i, t in enumerate(texts)}


def test_line_templates_of_one_leaf(spark):
    """Templates that share their token count and leading tokens: a large and a small one, then three without a majority; single lines stay."""
    kinds = [
        ("the shop says that {} may be sent back within thirty days", 30),
        ("the shop says our {} was made by hand in old towns", 20),
        ("read this now or {} shall close its doors for ever", 12),
        ("read this now while {} opens at noon on every day", 12),
        ("read this now because {} keeps fresh bread under white cloth", 12),
    ]
    texts, wanted = [], []
    for k, (form, n) in enumerate(kinds):
        for i in range(n):
            own = [" ".join(prose(seed + 100 * k + i, n_words).split()) for seed, n_words in ((9_000, 9), (7_000, 14))]
            texts.append("\n".join([own[0], form.format(SYLLABLES[i % 10] + SYLLABLES[i // 10] + "q"), own[1]]))
            wanted.append("\n".join(own))
    texts.append("the shop says nobody else ever wrote these eight plain words\nread this now and never again said one lonely old sign")
    wanted.append(texts[-1])
    got = by_id(line_dedup.drop_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    assert [got[i]["text"] for i in range(len(texts))] == wanted


def test_line_masking_of_long_tokens(spark):
    """Masking reads a token once: two megabytes without a space, with a digit elsewhere, take no noticeable time."""
    long = "x" * 2_000_000
    lines = [long + " 7", "a1 b 2c d3e 4", "no digit", "1", long + "9" + long]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    started = time.monotonic()
    got = [r[0] for r in frame.select(line_dedup._masked(F.col("line"))).collect()]
    assert got == [long + " <*>", "<*> b <*> <*> <*>", "no digit", "<*>", "<*>"] and time.monotonic() - started < 30


# 8 -----------------------------------------------------------------------------------------------


def test_html_blocks():
    tree = html_extract.train()
    wrong = [b for p in html_extract.LABELLED for b, row in zip(html_extract.blocks(p), html_extract.features(html_extract.blocks(p))) if html_extract.classify(tree, row) != b.text.startswith("main")]
    assert not wrong
    page = (
        "<html><head><title>t</title><script>if (a<b) x='</p>'</script></head><body><nav><a href='/'>home</a></nav><div class='cookie-notice'>we use cookies</div>"
        "<article><h1>Title &amp; more</h1><p>First&nbsp;  <b>bold</b>\n text &lt;x&gt;<p>second<br>line<form>mail us</form><!-- <p>no</p> --><style>p{}</style>"
        "<div id=comments><p>nice article, thanks to everyone</p></div></article><aside>read also</aside><footer>&copy; x</footer>"
    )
    assert html_extract.main_text(page, tree) == "Title & more\nFirst bold text <x>\nsecond\nline"
    assert [html_extract.main_text(x, tree) for x in (None, "", "<", "<p", "<article>", "<article><p>a</article")] == ["", "", "", "", "", "a"]


def splits(tree):
    return {html_extract.FEATURES[tree[0]]} | splits(tree[2]) | splits(tree[3]) if len(tree) == 4 else set()


def test_html_tree_looks_at_links_and_neighbours():
    tree = html_extract.train()
    used = splits(tree)
    assert used & {"link_density"} and used & {"words_before", "words_after", "links_before", "links_after"}
    long_, link = "a paragraph of the story that has more than a dozen words to read", "<a>another story of ours that has quite as many words as a paragraph</a>"
    page = f"<div><a>home</a></div><div>{link}</div><p>{long_}</p><p>yes.</p><p>{long_}</p><div>{link}</div>"
    assert html_extract.main_text(page, tree) == f"{long_}\nyes.\n{long_}"


def test_html_wrappers_and_attributes():
    tree, text = html_extract.train(), "a paragraph of the story that has more than a dozen words to read"
    page = f"<p>{text}</p><p>{text} again</p>"
    want = f"{text}\n{text} again"
    for before, after in (
        ('<div class="layout has-sidebar">', "</div>"),
        ('<div class="content with-sidebar"><article>', "</article></div>"),
        ('<div class="post has-comments">', "</div>"),
        ('<div id="search-page">', "</div>"),
        ("<div class='sidebar layout'><h1>main</h1>", "</div><div class=site-footer>all the terms</div>"),
    ):
        assert html_extract.main_text(before + page + after, tree).removeprefix("main\n") == want
    assert html_extract.main_text(f"<p title=it's>{text}</p><p data-class=ad title='a > b'>{text} isn't</p>", tree) == f"{text}\n{text} isn't"
    comments = f"<article><p>{text}</p></article><div class='comment-list'>{page}{page}</div>"
    assert html_extract.main_text(comments, tree) == text


def test_html_pages(spark, none):
    pages = spark.createDataFrame([(1, "u", None, 3), (None, None, "<article><p>x y</p></article>", 3), (2, "u", "<article><p>" + "w " * 50_000, 3)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got == {1: ("", 0), None: ("x y", 3), 2: (("w " * 50_000).strip(), 99_999)}
    assert html_extract.extract(pages.where("page_id < 0")).count() == 0


# 9 -----------------------------------------------------------------------------------------------


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    worded = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(again), failed


def plain_scores(trusted):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    data = lambda h: (h & ((1 << 64) - 1)).to_bytes(8, "little")
    grams = []
    for text in TEXTS:
        uni = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
        after = [*uni[1:], None][: len(uni)]
        pairs = [xxhash.xxh64_intdigest(data(b), s) if b is not None else s for a, b in zip(uni, after) for s in [xxhash.xxh64_intdigest(data(a), 42)]]
        grams.append([signed(g) % quality.BUCKETS for g in uni + pairs])
    raw, target = collections.Counter(), collections.Counter()
    for i, own in enumerate(grams):
        raw.update(own)
        if i in trusted:
            target.update(own)
    rate = sum(target.values()) / max(1, sum(raw.values()))
    weight = {b: round(math.log((target[b] + quality.SMOOTHING) / (n * rate + quality.SMOOTHING)) * quality.SCALE) for b, n in raw.items()}
    return [sum(weight[g] for g in own) / len(own) / quality.SCALE if own else 0.0 for own in grams]


def test_quality(docs, none, labels):
    got = by_id(quality.judge(docs, labels))
    scores = plain_scores({*range(18, 30), 6})
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, text in enumerate(TEXTS):
        want = plain_measures(text)
        assert tuple(got[i][c] for c in names) == want
        assert got[i]["score"] == pytest.approx(scores[i], abs=2e-6)
        assert got[i]["kept"] == (not want[-1] and got[i]["score"] >= quality.MIN_SCORE)
    assert quality.judge(none, labels).count() == 0
    assert all(r["score"] == 0 for r in quality.judge(docs, labels.where("quality > 5")).collect())
    assert quality.judge(docs.where("doc_id = 6").unionByName(docs.where("doc_id = 6")), labels).count() == 2


# 10 ----------------------------------------------------------------------------------------------


def test_licenses(docs, none):
    got = by_id(licenses.scan(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in enumerate(TEXTS):
        words = word.findall((text or "").translate(LOWER))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if " ".join(words[k : k + len(phrase.split())]) == phrase]
        places = [k for k, _ in at]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
    assert got[16]["labels"] == "apache-2.0" and got[17]["base_labels"] == "cc-by,gpl,reserved"
    assert licenses.scan(none).count() == 0


def test_normal_codes_of_many_texts():
    """Normal forms of a chunk at once equal those one by one, and so do hashes put together from halves."""
    rng = random.Random(11)
    for _ in range(300):
        texts = ["".join(rng.choice("aB .,\n\tÄßΣİ९漢-_\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        codes, starts = decontaminate.normal_codes(texts)
        want = [decontaminate.normal(t) for t in texts]
        assert codes.tobytes().decode("utf-32-le") == "\n".join(want)
        assert starts.tolist() == [sum(len(t) + 1 for t in want[:k]) for k in range(len(want))]
    codes = np.frombuffer(prose(3, 400).encode("utf-32-le"), dtype="<u4")
    grams = decontaminate._grams(codes)
    assert len(grams) == len(codes) - decontaminate.Q + 1
    by_text = collections.defaultdict(set)
    for k, g in enumerate(grams.tolist()):
        by_text[codes[k : k + decontaminate.Q].tobytes()].add(g)
    assert all(len(g) == 1 for g in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
