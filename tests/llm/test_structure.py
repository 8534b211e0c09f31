"""Whitening, conversation repair and mixing against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import conversation_repair, whitening

# ---- conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The fields of one conversation by a search over (cost, audit), which takes the cheapest and then least audit first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    blank = duplicate = truncated = 0
    seen, faults = set(), []
    for _, role, text in rows:
        written = text.rstrip(" \t\n\x0b\x0c\r")
        if not written:
            blank += 1
            faults.append("gone")
        elif (role, text) in seen:
            duplicate += 1
            faults.append("gone")
        elif written[-1] not in ".!?":
            truncated += 1
            faults.append("cut")
        else:
            faults.append("")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        new = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 2, audit + "I", i, new, (*lines, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if faults[i] != "gone":
                extra = faults[i] == "cut"
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, new, (*lines, f"{name}:{text}")))
                if role[:1] == new or (last == "" and role[:1] == "s"):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, audit, digest


def plain_conversations(rows):
    groups = {r[0]: [] for r in rows}
    for conv, *rest in plain_damage(rows):
        groups[conv].append(tuple(rest))
    return {conv: plain_repair(found) for conv, found in groups.items()}


def made_up_conversations(n, seed=3, longest=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "sys", "tool", "", None, "agent", "Über"]
    texts = ["Yes.", "No", "What is it?", "", " \n", None, "Ja!\n", "a\tb", "é", "Fine. ", "x" * 5000]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, longest)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"words {rng.randint(0, 10**6)}{rng.choice(['.', ''])}"
            rows.append((None if conv == 5 else conv, rng.choice([turn, turn, turn + rng.randint(0, 3), None]), rng.choice(roles), text))
    rng.shuffle(rows)
    return rows


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, copies int, fault int, cls string, piece int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], schema).repartition(3)


def repaired(frame, **bounds):
    rows = conversation_repair.damaged(frame)
    found = conversation_repair.summaries(*conversation_repair.repair(rows, **bounds)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[1:]) for r in found}


def test_repair(spark):
    rows = made_up_conversations(300)
    assert repaired(conversations(spark, rows)) == plain_conversations(rows)


def test_repair_of_long_conversations(spark, monkeypatch):
    """Cut into spans of a few turns, over several tasks."""
    rows = made_up_conversations(12, seed=8, longest=90) + [(77, t % 400, "user", "Same.") for t in range(1500)] + [(78, 1, "assistant", "Once.")] * 300
    rows += [(79, t, "au"[t % 2], f"Turn {t}.") for t in range(500)]
    monkeypatch.setattr(conversation_repair, "BATCH_TURNS", 7)
    frame = conversations(spark, rows)
    assert repaired(frame, long_turns=10) == plain_conversations(rows)


def test_repair_of_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert repaired(table) == plain_conversations(rows)


def test_repair_of_nothing(spark):
    assert repaired(conversations(spark, [])) == {}
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    want = {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(conversations(spark, [(dropped, 0, "user", "Gone.")])) == want
    one = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert repaired(conversations(spark, one))[1][0] is None


# ---- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, x double, n int").repartition(3)


def check_whitening(spark, rows, kept, components=4):
    frame = vectors(spark, rows)
    model = whitening.fit(frame)
    found = whitening.whiten(frame, model).collect()
    x = {i: np.array([math.floor(256 * float(np.float32(c))) for c in v], dtype=object) for i, v in kept}
    distinct = np.array(sorted({tuple(v) for v in x.values()}), dtype="float64")
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    centred = distinct - distinct.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    assert sorted((r["vec_id"], r["component"]) for r in found) == sorted((i, c) for i, _ in kept for c in range(1, k + 1))
    signs = {}
    for r in found:
        c = r["component"] - 1
        v = x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(v, sums))
        want = float((v.astype("float64") - distinct.mean(axis=0)) @ axes[:, c] / np.sqrt(values[c]))
        if abs(want) > 1e-6:
            signs.setdefault(c, np.sign(want * r["whitened"]))
            assert math.isclose(r["whitened"], want * signs[c], rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    return model


def test_whitening(spark):
    rng = np.random.default_rng(4)
    scale = np.linspace(1, 3, 40)
    rows = [(i, [float(c) for c in rng.standard_normal(40) * scale]) for i in range(400)]
    kept = rows + [(900 + i, rows[7][1]) for i in range(200)] + [(7, rows[8][1])]
    kept = [*{i: (i, v) for i, v in kept}.values()]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 39 + [None]), (2003, [math.nan] + [1.0] * 39), (2004, [-math.inf] + [1.0] * 39), (2005, [1.0] * 7)]
    model = check_whitening(spark, kept + bad, kept)
    assert model.axes.shape == (40, 4) and model.passes > 2


def test_whitening_of_hard_spectra(spark):
    rng = np.random.default_rng(5)
    steep = [(i, [float(c) for c in rng.standard_normal(30) * 10.0 ** np.linspace(4, 0, 30)]) for i in range(300)]
    check_whitening(spark, steep, steep)
    narrow = [(i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-40, 40, (50, 3)))]
    check_whitening(spark, narrow, narrow)
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    check_whitening(spark, line, line)


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5, 2.0])] * 9):
        frame = vectors(spark, rows)
        assert whitening.whiten(frame, whitening.fit(frame)).collect() == []


def test_filter_damps_the_unwanted_spectrum():
    values = np.array([10.0, 8.0, 3.0, 2.0, 1.0, 0.0])
    out = whitening._filtered(lambda q: values[:, None] * q, np.eye(6), 3.0, 8)
    gain = np.abs(np.diag(out))
    assert (gain[2:] <= 1 + 1e-9).all() and gain[0] > gain[1] > 1000
    wide = np.linspace(1, 2, 80) ** 3
    found, axes = whitening._leading(lambda q: wide[:, None] * q, 80, 4)
    assert np.allclose(found, wide[::-1][:4], rtol=1e-13) and np.allclose(np.abs(axes[-4:][::-1]), np.eye(4), atol=1e-11)


@pytest.mark.parametrize("length", [0, 1, 2, 5, 9])
def test_span_costs(length):
    from corpusmill.llm import turns

    rng = np.random.default_rng(length)
    cls, fault = rng.integers(0, 4, length), rng.integers(0, 3, length)
    table = np.array(turns.span_costs(cls, fault)).reshape(4, 4)
    for state in range(4):
        assert (table[state] + np.array(turns.END)).min() == turns.least_costs(cls, fault, turns.END, state)
