"""Best-fit packing of documents into sequences by exact complements.

Pieces are packed by their lengths alone: the plan is made on the histogram of lengths, ``CAPACITY`` counts whatever the
input, and every step moves many equal bins at once. For the longest remaining length, the gap it leaves is looked up among single lengths,
sums of pairs and sums of triples that are still available; combinations that fill it exactly are consumed as often as the
counts allow. What is left is placed best fit, longest first. Then each piece takes the place that its rank among the
pieces of its length has in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.ranks import with_rank
from corpusmill.llm.tokens import END, encoder
from corpusmill.session import cut_lineage

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, *, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids with id 0 at the end, cut every ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, spaced=spaced)
        step = 4 * capacity
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode(t.as_py() for t in batch.column("text"))):
                ids += END
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    out.append((doc_id, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(cut, PIECES)


def _exact(counts: np.ndarray, longest: int, gap: int, most: int) -> tuple[int, ...] | None:
    """One to ``most`` available lengths that sum to ``gap``, largest first, or None. ``longest`` is one length in use already."""
    counts = counts.copy()
    counts[longest] -= 1
    if most and counts[gap] > 0:
        return (gap,)
    if most < 2:
        return None
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    b = gap - a
    pair = np.flatnonzero((counts[a] > 0) & (counts[b] > 0) & ((a != b) | (counts[a] > 1)))
    if len(pair):
        return int(a[pair[0]]), int(b[pair[0]])
    if most < 3:
        return None
    there = np.flatnonzero(counts[: gap - 1])[::-1]
    for first in there:
        counts[first] -= 1
        rest = gap - int(first)
        a = np.arange(min(int(first), rest - 1), (rest - 1) // 2, -1)
        b = rest - a
        pair = np.flatnonzero((counts[a] > 0) & (counts[b] > 0) & ((a != b) | (counts[a] > 1)))
        counts[first] += 1
        if len(pair):
            return int(first), int(a[pair[0]]), int(b[pair[0]])
        if 3 * first < gap:
            break
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in a bin, number of such bins), from the counts of lengths 1 to ``capacity``.

    Filling gaps with triples can use up short pieces that later gaps need, so plans that stop at pairs, at single lengths, or go straight
    to best fit are made too, and the one with the fewest bins counts.
    """
    return min((_plan(histogram, capacity, most) for most in (3, 2, 1, 0)), key=lambda bins: sum(times for _, times in bins))


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    left: dict[int, int] = {}
    for longest in range(capacity - 1, 0, -1):
        while counts[longest]:
            fill = _exact(counts, longest, capacity - longest, most)
            if fill is None:
                break
            used = np.bincount((longest, *fill), minlength=capacity + 1)
            times = int((counts[used > 0] // used[used > 0]).min())
            counts -= used * times
            bins.append(((longest, *fill), times))
        left[longest] = int(counts[longest])
        counts[longest] = 0
    gaps: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # open bins by free room
    for length, n in left.items():
        room = length
        while n:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                many = capacity // length
                for size, times in ((many, n // many), (n % many, 1)):
                    if size and times:
                        gaps[capacity - size * length].append(((length,) * size, times))
                break
            held, times = gaps[room].pop()
            now = min(times, n)
            if times > now:
                gaps[room].append((held, times - now))
            gaps[room - length].append(((*held, length), now))
            n -= now
    return bins + [entry for entries in gaps for entry in entries]


def places(bins: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan by piece: of each length, from which rank on pieces go to which sequences, at which offset."""
    taken, rows, base = [0] * (capacity + 1), [], 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], base, offset))
            taken[length] += times
            offset += length
        base += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def pack(docs: DataFrame, path: str, *, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    Only doc_id and text are read, so other columns may have any name. Null and empty texts are the end id alone. Rows without
    doc_id name no document and are left out; repeated rows are packed each. An empty table gives no pieces. Ties go by doc_id
    and piece. The pieces (a few numbers per row) are kept in the shared folder, since the plan and the places both need them.
    """
    cut = cut_lineage(pieces(docs, path, spaced=spaced, capacity=capacity))
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # ``capacity`` rows at most
    table = places(plan(histogram, capacity), capacity)
    ranked = with_rank(cut, "length", ["doc_id", "piece"], "_rank", sum(histogram.values()))
    top = max(histogram.values(), default=0) + 1
    keys = table["length"] * top + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * top + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(table["offset"][at])], names=names)

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
