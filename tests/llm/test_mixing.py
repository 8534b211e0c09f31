"""Source mixing against a plain version, and its splitting tree against exact probabilities."""

from __future__ import annotations

import collections
import math
import random
import re
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string, k int, block string, size int, copies int, target string, draws int, shard int"


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def hashed(doc, size):
    """xxhash64 of (SEED, doc_id, size); nulls are passed over."""
    seed = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
    for p in (doc, size):
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def plain_targets(sizes):
    """Exact targets by repeated sharing. ``sizes``: words per source, None the null source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        target = {s: Fraction(left * weight[s], sum(weight[r] for r in rest)) for s in rest}
        over = [s for s in rest if target[s] > 3 * sizes[s]]
        if not over:
            return {**target, **capped}
        capped.update((s, Fraction(3 * sizes[s])) for s in over)


def plain_taken(rows, blocks):
    """(doc_id, size, source_size, target, taken) of every row, by going through each source's blocks in order."""
    held = collections.defaultdict(list)
    for doc, source, text in rows:
        held[source].append((doc, len(WORD.findall(text or ""))))
    sizes = {s: sum(n for _, n in found) for s, found in held.items()}
    targets = plain_targets(sizes) if rows else {}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    out = []
    for source, found in held.items():
        k, want = order.index(source) + 1, math.floor(targets[source] + Fraction(1, 2))
        whole, rest = divmod(want, sizes[source]) if sizes[source] else (0, 0)
        by_block = collections.defaultdict(list)
        for doc, n in found:
            h = hashed(doc, n)
            block = hashed_block(h) % blocks
            by_block[block].append((h, doc is not None, doc, n))
        for block in sorted(by_block, key=lambda b: (order_hash(k, b), b)):
            for _, _, doc, n in sorted(by_block[block], key=lambda r: (r[0], r[1], r[2] or 0, r[3])):
                part = min(n, rest)
                rest -= part
                out.append((doc, n, sizes[source], float(targets[source]), whole * n + part))
    return out


def hashed_block(h):
    seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), 42)
    return signed(xxhash.xxh64_intdigest(b"block", seed))


def order_hash(k, block):
    seed = 42
    for data in (mixing.SEED.to_bytes(4, "little"), b"order", k.to_bytes(4, "little"), block.to_bytes(8, "little")):
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def made_up(n=900, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 9 + ["b", "é", "Z", None, "tiny"])
        if source == "tiny" and i > 60:
            source = "hot"
        text = rng.choice([None, "", " \t\n"]) if rng.random() < 0.1 else " ".join(["wé"] * rng.choice([1, 3, 20, 20, 400])) + rng.choice(["", "\n", "\x0b x"])
        rows.append((None if i % 50 == 0 else i, source, text))
    return rows + [rows[3]] * 40 + [(5, "void", None), (2000, "long", "x " * 50_000)]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "b", 3, 4, "t", 5, 6) for r in rows], SCHEMA).repartition(partitions)


def near(rows):
    return sorted((r[0] is not None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4]) for r in rows)


@pytest.mark.parametrize("copies", [mixing.COPIES, 7])
def test_mix(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = made_up()
    mixed = mixing.mix(frame(spark, rows), blocks=16, shards=5)
    found = mixed.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert near(found) == near(plain_taken(rows, 16))
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    by_source = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.5 for r in by_source)
    again = mixing.mix(frame(spark, rows, 11), blocks=16, shards=5)
    assert sorted(map(str, again.drop("copy").collect())) == sorted(map(str, mixed.drop("copy").collect()))


def test_shards(spark):
    rows = [r for r in made_up(3000) if r[0] is not None]
    mixed = mixing.mix(frame(spark, rows), blocks=64, shards=6)
    parts = mixing.shuffled_shards(mixed).collect()
    assert {p["shard"] for p in parts} == set(range(6))
    assert sum(p["words"] for p in parts) == sum(r["taken"] for r in mixed.collect())
    draws = collections.defaultdict(set)
    for r in mixed.collect():
        block = hashed_block(hashed(r["doc_id"], r["size"])) % 64
        for d in r["draws"]:
            draws[r["source"], block, d["epoch"]].add(d["shard"])
    assert all(len(s) == 1 for s in draws.values())
    load = collections.Counter(next(iter(s)) for s in draws.values())
    assert max(load.values()) - min(load.values()) <= 2
    places = collections.defaultdict(list)
    for p in parts:
        places[p["shard"]].append(p["place"])
    assert all(p == sorted(p) for p in places.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    found = mixing.mix(frame(spark, [(1, "a", None), (2, None, " ")])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("marked,total,drawn", [(3, 10, 4), (50, 120, 60), (1, 2000, 1000), (1999, 2000, 7), (900, 3000, 1500), (5, 5, 3), (0, 9, 4), (4, 9, 0)])
def test_hypergeometric(spark, marked, total, drawn):
    """Inversion agrees with exact probabilities for a grid of u."""
    grid = [(i + 0.5) / 199 for i in range(199)]
    rows = spark.createDataFrame([(u,) for u in grid], "u double")
    found = rows.select("u", mixing._hypergeometric(*[F.lit(v).cast("long") for v in (marked, total, drawn)], F.col("u")).alias("x")).collect()
    ways = [math.comb(marked, x) * math.comb(total - marked, drawn - x) for x in range(min(marked, drawn) + 1)]
    for r in found:
        below, x = 0, 0
        while (below + ways[x]) / sum(ways) <= r["u"]:
            below += ways[x]
            x += 1
        assert r["x"] == x


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_splitting_tree(spark, shards):
    quota = [0, 1, 17, 4096, 300, 12_000]
    found = mixing.splitting_tree(spark.createDataFrame([(quota,)], "quota array<long>"), shards).collect()
    assert sorted(r["shard"] for r in found) == list(range(shards))
    assert [sum(r["quota"][i] for r in found) for i in range(len(quota))] == quota
    sizes = [sum(r["quota"]) for r in found]
    assert max(sizes) - min(sizes) <= shards
    for i, q in enumerate(quota):  # within six standard deviations of an even share
        assert all(abs(r["quota"][i] - q / shards) <= 6 * math.sqrt(q / shards) + 1 for r in found)
