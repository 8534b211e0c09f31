"""Exact substring dedup by longest-previous-factor arrays over shared suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in the same one.

The suffix array of a whole corpus does not fit one task, so suffixes that can share ``LENGTH`` bytes are brought together first. Each window
of that many bytes has an anchor, its ``GRAM``-byte string of least hash; equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a cell, about 35 windows long. Cells meet by anchor:

* a cell equal to an earlier one is repeated as a whole;
* of cells that differ but share their anchor, the bytes are fetched, their suffixes sorted, and the longest previous factor of each suffix is taken
  from its previous and next smaller positions in suffix order. Where it reaches ``LENGTH``, the window is repeated.

Equal cells of one batch are merged before the shuffle. Anchors that hold more than a small share of all cells (a bounded list, found by
a first pass) are dealt out window by window instead, keyed by the window's own hash, so no task gathers a hot anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import mix
from corpusmill.session import cut_lineage

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Bytes of text per bucket of documents and per bucket of cells, and bytes and cells handled at once inside a task.
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
BATCH_CELLS = 200_000
#: An anchor is hot if it has this many cells, and more than one of ``HOT_SHARES`` parts of all cells.
HOT_CELLS = 4096
HOT_SHARES = 1 << 17
BATCH_WINDOWS = 1 << 17

CELL = np.dtype([("anchor", "<u8"), ("cell", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("flag", "u1")])
RUN = np.dtype([("doc", "<i8"), ("anchor", "<u8"), ("start", "<u4"), ("n", "u1"), ("flag", "u1")])
COVERED, FETCH = 1, 2
PACKED = "bucket long, data binary"
DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"

_RANDOM = np.random.default_rng(11)
_TABLES = [_RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=8)
def _powers(base: int, log: int) -> np.ndarray:
    out = np.full(1 << log, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any spans of a run of bytes, in two independent ways."""

    def __init__(self, codes: np.ndarray, which: int):
        log = max(10, int(len(codes) + 1).bit_length())
        base = _BASES[which]
        self.back = _powers(pow(base, -1, 1 << 64), log)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_TABLES[which][codes] * _powers(base, log)[: len(codes)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.back[starts] + (stops - starts).astype(np.uint64))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """``pmod(xxhash64(id), buckets)`` of 64-bit integers, as Spark computes it."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.uint64(42 + 8) + five
    h = h ^ (turn(np.asarray(ids).astype(np.int64).view(np.uint64) * two, 31) * one)
    h = turn(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64) % buckets


def cells(texts: list[bytes], docs: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """The cells of texts; those of hot anchors window by window. Without ``hot``, only the anchors of the cells."""
    codes = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(sizes)
    if len(codes) < LENGTH or sizes.max(initial=0) < LENGTH:
        return np.zeros(0, dtype=np.uint64 if hot is None else CELL)
    one = Hashes(codes, 0)
    at = np.arange(len(codes) - GRAM + 1)
    grams = one.spans(at, at + GRAM)
    bits = np.uint64(int(len(codes)).bit_length())
    least = (grams >> bits << bits) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= WINDOW:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - reach)], least[WINDOW - reach :])
    anchors = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that starts at each place
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchors)]
    valid = np.arange(len(anchors)) + LENGTH <= stops[text]
    places = np.flatnonzero(valid)
    if not len(places):
        return np.zeros(0, dtype=np.uint64 if hot is None else CELL)
    own = anchors[places]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (places[1:] != places[:-1] + 1)])
    starts, counts, anchor = places[new], np.diff(np.r_[new, len(places)]), own[new]
    keys = grams[anchor]
    if hot is None:
        return keys
    two = Hashes(codes, 1)
    if len(hot):
        where = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        is_hot = hot[where] == keys
        each = np.where(is_hot, counts, 1)
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        single = np.repeat(is_hot, each)
        starts, counts, keys = np.repeat(starts, each) + within, np.where(single, 1, np.repeat(counts, each)), np.repeat(keys, each)
        keys = np.where(single, mix(one.spans(starts, starts + LENGTH) + np.uint64(1)), keys)
        anchor = np.repeat(anchor, each)
    out = np.zeros(len(starts), dtype=CELL)
    out["anchor"] = keys
    out["cell"] = mix(two.spans(starts, starts + counts + LENGTH - 1) + (anchor - starts).astype(np.uint64))
    out["doc"] = docs[text[starts]]
    out["start"] = starts - (stops - sizes)[text[starts]]
    out["n"] = counts
    return out


def repeated(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of cells: which equal an earlier one, and the order (anchor, cell, position) that shows it."""
    order = np.lexsort((found["start"], found["doc"], found["cell"], found["anchor"]))
    s = found[order]
    new = np.r_[True, (s["anchor"][1:] != s["anchor"][:-1]) | (s["cell"][1:] != s["cell"][:-1])][: len(s)]
    head = s[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else s
    later = ~new & ((s["doc"] != head["doc"]) | (s["start"] != head["start"]))  # not the same place of a repeated row
    return later, order


def longest_previous(suffixes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, up to the suffixes' width: rows of bytes, and each row's position in the corpus.

    In suffix order, the earlier suffix with the longest common prefix is the nearest one of smaller position before or behind. Both are found
    for all suffixes at once by jumping along pointers; the common prefix on the way is the least one passed.
    """
    n, width = suffixes.shape
    order = np.lexsort((positions, np.ascontiguousarray(suffixes).view(f"S{width}").ravel()))
    ranked, where = suffixes[order], positions[order]
    same = ranked[1:] == ranked[:-1]
    common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))  # of neighbours in suffix order
    best = np.zeros(n, dtype=np.int64)
    for place, shared in ((where, common), (where[::-1], common[::-1])):
        at, passed = np.arange(n) - 1, np.r_[0, shared].astype(np.int64)
        open_ = np.flatnonzero((at >= 0) & (passed > 0))
        while True:
            open_ = open_[place[at[open_]] >= place[open_]]
            if not len(open_):
                break
            step = at[open_]
            passed[open_] = np.minimum(passed[open_], passed[step])
            at[open_] = at[step]
            open_ = open_[(at[open_] >= 0) & (passed[open_] > 0)]
        smaller = np.where((at >= 0) & (place[np.maximum(at, 0)] < place), passed, 0)
        best = np.maximum(best, smaller if place is where else smaller[::-1])
    out = np.empty(n, dtype=np.int64)
    out[order] = best
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = (value.as_py() or "").encode()
            if len(text) >= LENGTH:
                ids.append(key)
                texts.append(text)
                size += len(text)
            if size > CHUNK_BYTES:
                yield np.array(ids, dtype=np.int64), texts
                ids, texts, size = [], [], 0
    if texts:
        yield np.array(ids, dtype=np.int64), texts


def _cell_batches(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None) -> Iterator[np.ndarray]:
    held, n = [], 0
    for ids, texts in _texts(batches):
        held.append(cells(texts, ids, hot))
        n += len(held[-1])
        if n > BATCH_CELLS:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _dealt(rows: np.ndarray, buckets: np.ndarray, extra: list[bytes] | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) of records dealt by bucket."""
    order = np.argsort(buckets, kind="stable")
    ranked = buckets[order]
    cuts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else []
    for a, b in zip(cuts, [*cuts[1:], len(ranked)] if len(ranked) else []):
        yield int(ranked[a]), _pack(rows[order[a:b]])


def _pack(rows: np.ndarray) -> bytes:
    """Records column by column, compressed."""
    data = b"".join(rows[name].tobytes() for name in rows.dtype.names)
    return len(rows).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.empty(n, dtype=dtype)
    plain, at = pa.decompress(data[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True), 0
    for name in dtype.names:
        size = n * dtype[name].itemsize
        out[name] = np.frombuffer(plain[at : at + size], dtype=dtype[name])
        at += size
    return out


def _batch(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["bucket", "data"])


def hot_anchors(rows: DataFrame, total_bytes: int) -> np.ndarray:
    """Every anchor with more than ``HOT_CELLS`` and more than ``2 / HOT_SHARES`` of all cells; ``2 * HOT_SHARES`` anchors at most.

    A batch reports the anchors that hold at least half a hot anchor's share of its own cells, so what a hot anchor has in batches that
    do not report it is less than half its cells, and half the bound on the reported sum finds it.
    """
    every = max(1, total_bytes * 2 // (WINDOW + 1))
    bound = max(HOT_CELLS, every // HOT_SHARES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _cell_batches(batches, None):
            keys, n = np.unique(found, return_counts=True)
            much = n >= max(2, len(found) * bound / every / 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[much].view(np.int64)), pa.array(n[much])], names=["anchor", "n"])

    sums = rows.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= bound // 2)
    return np.sort(np.array([r["anchor"] for r in sums.collect()], dtype=np.int64).view(np.uint64))


def repeated_windows(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed runs by document bucket: repeated cells, and the cells whose bytes are to be compared."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _cell_batches(batches, hot):
            later, order = repeated(found)
            found = found[order]
            found["flag"] = later * COVERED
            bucket = np.where(later, bucket_of(found["doc"], buckets), (found["anchor"] % np.uint64(buckets)).astype(np.int64))
            found["anchor"][later] = found["cell"][later] = 0
            yield _batch(list(_dealt(found, bucket)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(d.as_py(), CELL) for batch in batches for d in batch.column("data")]
        if not held:
            return
        found = np.concatenate(held)
        held.clear()
        known, found = found[found["flag"] == COVERED], found[found["flag"] == 0]
        later, order = repeated(found)
        s = found[order]
        del found, order
        fresh = s[~later]
        different = np.r_[False, (fresh["anchor"][1:] == fresh["anchor"][:-1]) & (fresh["cell"][1:] != fresh["cell"][:-1])]
        groups = np.cumsum(np.r_[True, fresh["anchor"][1:] != fresh["anchor"][:-1]]) - 1 if len(fresh) else np.zeros(0, dtype=np.int64)
        mixed = np.bincount(groups, weights=different[: len(fresh)], minlength=1)[groups] > 0 if len(fresh) else np.zeros(0, dtype=bool)
        out = []
        for part, flag in ((known, COVERED), (s[later], COVERED), (fresh[mixed], FETCH)):
            run = np.zeros(len(part), dtype=RUN)
            for name in ("doc", "anchor", "start", "n"):
                run[name] = part[name]
            run["flag"] = flag
            if flag == COVERED:
                run["anchor"] = 0
            out.append(run)
        runs = np.concatenate(out)
        yield _batch(list(_dealt(runs, bucket_of(runs["doc"], buckets))))

    return rows.mapInArrow(emit, PACKED).repartition(buckets, "bucket").mapInArrow(meet, PACKED)


def _runs(table: pa.Table) -> np.ndarray:
    held = [_unpack(d.as_py(), RUN) for d in table.column("data")]
    return np.concatenate(held) if held else np.zeros(0, dtype=RUN)


def _bytes_of(docs: pa.Table) -> dict[int, bytes]:
    return {k: (t.as_py() or "").encode() for k, t in zip(docs.column("doc_id").to_pylist(), docs.column("text"))}


def compared_windows(dealt: DataFrame, runs: DataFrame, buckets: int) -> DataFrame:
    """Packed runs of the fetched cells' windows that are repeated, by document bucket."""

    def fetch(docs: pa.Table, packed: pa.Table) -> pa.Table:
        wanted = _runs(packed)
        wanted = wanted[wanted["flag"] == FETCH]
        texts = _bytes_of(docs)
        bucket = (wanted["anchor"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        wanted, bucket = wanted[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
        keys, data, content = [], [], []
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
            part = wanted[a:b]
            pieces = [texts[d][s : s + n + LENGTH - 1] for d, s, n in zip(part["doc"].tolist(), part["start"].tolist(), part["n"].tolist())]
            keys.append(int(bucket[a]))
            data.append(_pack(part))
            content.append(b"".join(pieces))
        return pa.table({"bucket": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary()), "content": pa.array(content, pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, contents = [], []
        for batch in batches:
            runs += [_unpack(d.as_py(), RUN) for d in batch.column("data")]
            contents += [c.as_py() for c in batch.column("content")]
        if not runs:
            return
        found, codes = np.concatenate(runs), np.frombuffer(b"".join(contents), dtype=np.uint8)
        ends = np.cumsum(found["n"].astype(np.int64) + LENGTH - 1)
        begins = ends - found["n"] - (LENGTH - 1)
        order = np.lexsort((found["start"], found["doc"], found["anchor"]))
        found, begins = found[order], begins[order]
        windows = np.cumsum(found["n"].astype(np.int64))
        new = np.flatnonzero(np.r_[True, found["anchor"][1:] != found["anchor"][:-1]])
        first = 0
        out = []
        while first < len(found):  # whole anchors, about BATCH_WINDOWS at a time
            before = windows[first - 1] if first else 0
            later = new[new > first]
            fits = later[windows[later - 1] - before <= BATCH_WINDOWS]
            stop = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(found)
            if len(later) and windows[-1] - before <= BATCH_WINDOWS:
                stop = len(found)
            part, at = found[first:stop], begins[first:stop]
            n = part["n"].astype(np.int64)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            suffixes = codes[(np.repeat(at, n) + within)[:, None] + np.arange(LENGTH)]
            doc, start = np.repeat(part["doc"], n), np.repeat(part["start"], n) + within
            _, position = np.unique(np.stack([doc, start]), axis=1, return_inverse=True)
            hit = longest_previous(suffixes, position.ravel()) >= LENGTH
            run = np.zeros(int(hit.sum()), dtype=RUN)
            run["doc"], run["start"], run["n"], run["flag"] = doc[hit], start[hit], 1, COVERED
            out.append(run)
            first = stop
        runs = np.concatenate(out)
        yield _batch(list(_dealt(runs, bucket_of(runs["doc"], buckets))))

    fetched = dealt.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(fetch, PACKED + ", content binary")
    return fetched.repartition(buckets, "bucket").mapInArrow(compare, PACKED)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (starts and ends of removed runs, in turn) of every document.

    Only doc_id and text are read, so other columns may have any name. Null and empty texts have no bytes; texts of less than ``LENGTH`` bytes lose
    none. Rows without doc_id name no document and are left out. Rows that repeat a doc_id with the same text are one document at one place: each
    comes out, with the same result; differing texts under one doc_id are not defined. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    hot = hot_anchors(rows, total)
    runs = cut_lineage(repeated_windows(rows, buckets, hot))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    every = runs.unionByName(compared_windows(dealt, runs, buckets))

    def finish(docs: pa.Table, packed: pa.Table) -> pa.Table:
        found = _runs(packed)
        covered = np.flatnonzero(found["flag"] == COVERED)
        covered = covered[np.argsort(found["doc"][covered], kind="stable")]
        keys, starts = found["doc"][covered], found["start"][covered].astype(np.int64)
        stops = starts + found["n"][covered] + (LENGTH - 1)
        ids = docs.column("doc_id").to_numpy()
        first = np.searchsorted(keys, ids)
        counts = np.searchsorted(keys, ids, side="right") - first
        texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        removed: list[list[int]] = [[] for _ in texts]
        touched = np.flatnonzero(counts)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes[touched]) // CHUNK_BYTES)) + 1
        for part in np.split(touched, cut) if len(touched) else []:
            # one stretch for the texts of a part, each with a byte behind it that no run covers
            bases = np.cumsum(sizes[part] + 1) - sizes[part] - 1
            length = int(bases[-1] + sizes[part[-1]]) + 2
            n = counts[part]
            own = np.repeat(first[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            base = np.repeat(bases, n)
            depth = np.cumsum(np.bincount(base + starts[own], minlength=length) - np.bincount(base + stops[own], minlength=length))
            edges = np.flatnonzero(np.diff(np.r_[False, depth > 0].view(np.int8)))
            whose = np.searchsorted(edges, np.r_[bases, length])
            inside = edges - np.repeat(bases, np.diff(whose))
            for k, a, b in zip(part.tolist(), whose[:-1].tolist(), whose[1:].tolist()):
                removed[k] = inside[a:b].tolist()
        digests, gone = [], []
        for text, edges_ in zip(texts, removed):
            digest, at, left = hashlib.sha256(), 0, 0
            for start, stop in zip(edges_[::2], edges_[1::2]):
                digest.update(text[at:start])
                left += stop - start
                at = stop
            digest.update(text[at:])
            digests.append(digest.hexdigest())
            gone.append(left)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array(sizes),
            pa.array(gone, pa.int64()),
            pa.array([len(e) // 2 for e in removed], pa.int64()),
            pa.array(digests, pa.string()),
            pa.array(removed, pa.list_(pa.int64())),
        ]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return dealt.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(finish, DONE)
