"""MinHash near-dedup with an LSH forest.

Every distinct shingle set has a signature of ``TREES * STRIDE`` minima. Order t reads it from value ``t * STRIDE`` on, round its end, and all sets
are sorted in each order, so that sets with a long common prefix stand next to each other. Neighbours that agree in the first ``DEPTH``
values of an order are candidates. Two sets of similarity 0.85 miss each other in all orders with a chance below 1e-8, of similarity
0.8 below 1e-5. A run of candidates gives an edge from each set to its first, so edges are linear in the sets whatever the runs' lengths; they make
families. The order is dealt out by ranges, so a run may span tasks.

A family's sets are brought together once and every pair is counted exactly by an index of their shingles. In a family too large for one
task each set is first counted against the neighbour with which it has the longest common prefix, then a few times against one set of each of
its regions, a region being the sets that agree in ``DEPTH`` values. A crowded region, which does not fit into a task, is then read deeper, up to ``DEEPEST``
values, each part as deep as it takes to fit. Last, crowded regions that still hold different components are cut into blocks, and each pair of blocks
that may hold a new link is a task of its own: deeper reading saves work and loses no link. Links then give components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.shingles import shingle_sets
from corpusmill.session import cut_lineage, stored

TREES = 32
STRIDE = 5
#: Values of an order in which candidates agree, and the most that crowded regions are read to.
DEPTH = 5
DEEPEST = 12
#: A value is kept as its low 16 bits, high byte first: equal minima stay equal, others agree by chance once in 65,536.
VALUE = np.dtype(">u2")
#: The most sets and shingles of sets that one task compares with each other.
FAMILY_SETS = 3_000
FAMILY_SHINGLES = 4_000_000
#: How often the sets of a large family are counted against one set of each of their regions.
STARS = 3
CHUNK_BYTES = 1 << 20

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"
MEMBER = "key long, hub boolean, doc_id long, shingles binary"
LINK = "a long, b long"
NEIGHBOUR = "a long, first long, other long, common int, border binary"

_SEEDS = np.random.default_rng(7).integers(0, 1 << 32, (2, TREES * STRIDE), dtype=np.uint32)


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """Rows of ``values`` minima for non-empty sets."""
    parts = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((values, len(sets)), dtype=np.uint32)
    buffer = np.empty_like(parts)
    for k in range(values):
        np.bitwise_xor(parts, _SEEDS[0, k], out=buffer)
        buffer *= _SEEDS[1, k] | np.uint32(1)
        buffer ^= buffer >> np.uint32(15)
        buffer *= np.uint32(0x85EBCA6B)
        out[k] = np.minimum.reduceat(buffer, starts)
    return out.T


def common_prefixes(trees: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each row but the first, how many leading values it has in common with the row before it; none with another tree's."""
    same = (codes[1:] == codes[:-1]) & (trees[1:] == trees[:-1])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[bytes]]]:
    """Rows without their text, and the texts, about ``CHUNK_BYTES`` at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        others = batch.drop_columns(["text"]).to_pylist()
        for row, value in zip(others, batch.column("text")):
            rows.append(row)
            texts.append((value.as_py() or "").encode())
            size += len(texts[-1])
            if size > CHUNK_BYTES:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches):
            sets = shingle_sets(texts, width)
            full = [k for k, s in enumerate(sets) if len(s)]
            signed: list = [None] * len(sets)
            if full:
                found = signatures([sets[k] for k in full], TREES * STRIDE)
                found = np.hstack([found, found[:, :DEEPEST]]).astype(VALUE)
                for k, values in zip(full, found):
                    signed[k] = values.tobytes()
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype="<i8").reshape(-1, 2)
            columns = [
                pa.array([r["doc_id"] for r in rows], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests[:, 0]),
                pa.array(digests[:, 1]),
                pa.array(signed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.mapInArrow(run, SIGNED)


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component, by counting the shared shingles of every pair that shares one."""
    n = len(sets)
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    ranked, holders = every[order], owner[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.cumsum(new) - 1
    first = np.r_[np.flatnonzero(new), len(ranked)]
    group_of = np.empty(len(every), dtype=np.int64)
    group_of[order] = group
    at = np.r_[0, np.cumsum(sizes)]
    for k in range(n):
        groups = group_of[at[k] : at[k + 1]]
        lengths = first[groups + 1] - first[groups]
        if lengths.max() == 1:
            continue
        take = np.repeat(first[groups] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(holders[take], minlength=n)
        near = np.flatnonzero(100 * shared >= percent * (sizes + sizes[k] - shared))
        for other in near[near < k].tolist():
            a, b = find(k), find(other)
            root[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(n)])


def _orders(reps: DataFrame) -> DataFrame:
    """doc_id, n_shingles, tree and code, the first ``DEEPEST`` values of that order, whose bytes sort as the values do."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    code = F.substring("signature", VALUE.itemsize * STRIDE * F.col("tree") + 1, F.lit(VALUE.itemsize * DEEPEST))
    return reps.select("doc_id", "n_shingles", "signature", trees).select("doc_id", "n_shingles", "tree", code.alias("code"))


def _neighbours(reps: DataFrame) -> DataFrame:
    """Neighbours in the sorted orders that agree in ``DEPTH`` values or more: a, the first of its run, the set before it, and their common prefix.

    Rows with a border name the runs at a range's ends, by the values that all of a run share.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(*columns: list) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["a", "first", "other", "common", "border"])

        def border(tree: int, code: np.ndarray, first: int) -> pa.RecordBatch:
            return rows([first], [first], [None], [None], [int(tree).to_bytes(4, "big") + code[:DEPTH].tobytes()])

        last = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            trees, ids = batch.column("tree").to_numpy(), batch.column("doc_id").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=VALUE).reshape(n, DEEPEST)
            if last is None:
                yield border(trees[0], codes[0], ids[0])
                last = trees[:1] - 1, codes[:1], ids[:1], ids[0]
            common = common_prefixes(np.r_[last[0], trees], np.vstack([last[1], codes]))
            joined = common >= DEPTH
            start = np.maximum.accumulate(np.where(joined, -1, np.arange(n)))
            first = np.where(start < 0, last[3], ids[start])
            before = np.r_[last[2], ids[:-1]]
            yield rows(ids[joined], first[joined], before[joined], common[joined], [None] * int(joined.sum()))
            last = trees[-1:], codes[-1:], ids[-1:], first[-1]
        if last is not None:
            yield border(last[0][0], last[1][0], last[3])

    ordered = _orders(reps).select("tree", "code", "doc_id").repartitionByRange("tree", "code", "doc_id").sortWithinPartitions("tree", "code", "doc_id")
    return stored(ordered.mapInArrow(scan, NEIGHBOUR), "near-neighbours")


def _families(reps: DataFrame, neighbours: DataFrame) -> DataFrame:
    """doc_id, family, and the family's sets and shingles, of representatives that have neighbours."""
    borders = neighbours.where("border IS NOT NULL").select("border", "first")
    lowest = borders.groupBy("border").agg(F.min("first").alias("b"))
    spanning = borders.join(lowest, "border").select(F.col("first").alias("a"), "b")
    edges = neighbours.where("border IS NULL").select("a", F.col("first").alias("b")).unionByName(spanning)
    found = components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("family"))
    members = found.join(reps.select("doc_id", "n_shingles"), "doc_id")
    sizes = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total"))
    return members.select("doc_id", "family").join(sizes, "family")


def _parts(sets: Column, shingles: Column, share: int = 1) -> Column:
    """The number of parts that hold at most the ``share``-th part of what one task compares."""
    return F.greatest(F.ceil(share * sets / FAMILY_SETS), F.ceil(share * shingles / FAMILY_SHINGLES), F.lit(1)).cast("int")


def _hash_part(parts: Column, seed: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), parts).cast("int")


def _compared(docs: DataFrame, places: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges between similar sets that meet under a key. ``places``: key, hub, doc_id; under a key with a hub, sets are counted against it only."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches):
            sets = shingle_sets(texts, width)
            keys, hubs, ids, data, size = [], [], [], [], 0

            def batch() -> pa.RecordBatch:
                columns = [pa.array(keys, pa.int64()), pa.array(hubs, pa.bool_()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["key", "hub", "doc_id", "shingles"])

            for row, own in zip(rows, sets):
                value = own.tobytes()
                for place in row["places"]:
                    keys.append(place["key"])
                    hubs.append(place["hub"])
                    ids.append(row["doc_id"])
                    data.append(value)
                    size += len(value)
                    if size > 16 * CHUNK_BYTES:
                        yield batch()
                        keys, hubs, ids, data, size = [], [], [], [], 0
            yield batch()

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        sets = [np.frombuffer(group.column("shingles")[int(k)].as_py(), dtype=np.uint64) for k in order]
        hubs = group.column("hub").to_numpy(zero_copy_only=False)[order]
        ids = ids[order]
        first = np.arange(len(ids))
        if hubs.any():
            hub = int(hubs.argmax())
            shared = np.array([np.isin(s, sets[hub], assume_unique=True).sum() for s in sets])
            sizes = np.array([len(s) for s in sets])
            first[100 * shared >= percent * (sizes + sizes[hub] - shared)] = hub
        elif len(sets) > 1:
            first = link(sets, percent)
        linked = first != np.arange(len(ids))
        return pa.table({"a": ids[linked], "b": ids[first[linked]]})

    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "hub")).alias("places"))
    return docs.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(keyed, MEMBER).groupBy("key").applyInArrow(compare, LINK)


def _stars(leaves: DataFrame, turn: int) -> DataFrame:
    """Places that bring each set to one set of another component in each of its regions. A hub's sets are dealt out to bounded tasks."""
    order = F.xxhash64("doc_id", F.lit(turn))
    hubs = leaves.groupBy("region").agg(F.min(F.struct(order.alias("order"), "doc_id", "component")).alias("h"), F.min("component").alias("low"), F.max("component").alias("high"))
    hubs = hubs.where("low < high").select("region", F.col("h.doc_id").alias("hub_id"), F.col("h.component").alias("of_hub"))
    pairs = leaves.join(hubs, "region").where("component <> of_hub").select("doc_id", "n_shingles", "hub_id").distinct()
    tasks = pairs.groupBy("hub_id").agg(_parts(F.count("*"), F.sum("n_shingles")).alias("parts"))
    members = pairs.join(tasks, "hub_id").select("hub_id", "doc_id", _hash_part(F.col("parts"), "star").alias("part"), F.lit(False).alias("hub"))
    own = tasks.select("hub_id", F.col("hub_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("hub"))
    return members.unionByName(own).select(F.xxhash64("hub_id", "part").alias("key"), "hub", "doc_id")


def _longest(neighbours: DataFrame, large: DataFrame) -> DataFrame:
    """Places that bring each set to the neighbour with which it has the longest common prefix. A set has two neighbours in an order."""
    pairs = neighbours.where("border IS NULL AND a <> other").select("a", "other", "common").join(large.withColumnRenamed("doc_id", "a"), "a", "left_semi")
    both = pairs.unionByName(pairs.select(F.col("other").alias("a"), F.col("a").alias("other"), "common"))
    best = both.groupBy("a").agg(F.max(F.struct("common", "other")).alias("best")).select(F.col("best.other").alias("key"), F.col("a").alias("doc_id"))
    hubs = best.select("key").distinct().select("key", F.lit(True).alias("hub"), F.col("key").alias("doc_id"))
    return best.select("key", F.lit(False).alias("hub"), "doc_id").unionByName(hubs)


def _regions(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, region and crowded for regions of ``DEPTH`` values, and the same for the parts of crowded ones at the least depth at which they fit into a task."""

    def region(depth: Column) -> Column:
        return F.xxhash64("tree", F.substring("code", F.lit(1), F.lit(VALUE.itemsize) * depth))

    shallow = orders.withColumn("region", region(F.lit(DEPTH)))
    sizes = shallow.groupBy("region").agg(F.count("*").alias("n"), (_parts(F.count("*"), F.sum("n_shingles")) > 1).alias("crowded")).where("n > 1").drop("n")
    every = cut_lineage(shallow.join(sizes, "region"))
    depths = F.explode(F.sequence(F.lit(DEPTH + 1), F.lit(DEEPEST))).alias("depth")
    deeper = every.where("crowded").select("doc_id", "n_shingles", "tree", "code", depths).withColumn("region", region(F.col("depth")))
    fitting = deeper.groupBy("region").agg(F.count("*").alias("n"), _parts(F.count("*"), F.sum("n_shingles")).alias("parts")).where("parts = 1").drop("parts")
    least = deeper.join(fitting, "region").groupBy("doc_id", "tree").agg(F.min(F.struct("depth", "region", "n", "n_shingles")).alias("least"))
    parts = least.where("least.n > 1").select("doc_id", "least.n_shingles", "least.region", F.lit(False).alias("crowded"))
    return every.select("doc_id", "n_shingles", "region", "crowded"), cut_lineage(parts)


def _whole(leaves: DataFrame) -> DataFrame:
    """Places for the regions, each small enough for a task, that hold different components."""
    mixed = leaves.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region")
    return leaves.join(mixed, "region", "left_semi").select(F.col("region").alias("key"), F.lit(False).alias("hub"), "doc_id")


def _blocks(leaves: DataFrame) -> DataFrame:
    """Places for every pair of sets of one crowded region that are in different components.

    Components that fill blocks have blocks of their own, which do not meet each other, and the rest is dealt out to common blocks.
    """
    of = leaves.groupBy("region", "component").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total"))
    of = of.withColumn("own", _parts(F.col("sets"), F.col("total"), 2)).withColumn("filled", F.col("own") > 1)
    rest = lambda c: F.coalesce(F.sum(F.when(~F.col("filled"), F.col(c))), F.lit(0))
    regions = of.groupBy("region").agg(
        F.count("*").alias("components"), rest("sets").alias("sets"), rest("total").alias("total")
    )
    large = regions.where("components > 1").select("region", F.when(F.col("sets") > 0, _parts(F.col("sets"), F.col("total"), 2)).otherwise(0).alias("common"))
    filled = of.where("filled").select("region", "component", "own")
    owns = filled.join(large.select("region"), "region").select("region", F.col("component").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("part"))
    commons = large.where("common > 0").select("region", F.lit(None).cast("long").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("common") - 1)).alias("part"))
    blocks = owns.unionByName(commons).withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "part"))
    other = blocks.select("region", F.col("owner").alias("other_owner"), F.col("block").alias("other"))
    meeting = blocks.join(other, "region").where("owner IS NULL OR other_owner IS NULL OR owner <> other_owner").select("region", "block", "other")
    members = leaves.join(large, "region").join(filled, ["region", "component"], "left")
    part = F.when(F.col("own").isNotNull(), _hash_part(F.col("own"), "own")).otherwise(_hash_part(F.col("common"), "common"))
    owner = F.when(F.col("own").isNotNull(), F.col("component"))
    members = members.select("region", "doc_id", F.xxhash64(F.coalesce(owner, F.lit(0)), owner.isNull(), part).alias("block"))
    key = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    return members.join(meeting, ["region", "block"]).select(key.alias("key"), F.lit(False).alias("hub"), "doc_id")


def _links(docs: DataFrame, reps: DataFrame, neighbours: DataFrame, families: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges that connect linked representatives: within their family, or for large families by neighbours and regions."""
    families = families.withColumn("large", (F.col("sets") > FAMILY_SETS) | (F.col("total") > FAMILY_SHINGLES))
    whole = families.where("NOT large").select(F.col("family").alias("key"), F.lit(False).alias("hub"), "doc_id")
    links = _compared(docs, whole, width, percent)
    large = families.where("large").select("doc_id")
    if large.isEmpty():
        return links
    every, parts = _regions(_orders(reps.join(large, "doc_id", "left_semi")))
    found = cut_lineage(_compared(docs, _longest(neighbours, large), width, percent))

    def told(leaves: DataFrame) -> DataFrame:
        roots = components(found).select(F.col("node").alias("doc_id"), "root")
        return cut_lineage(leaves.join(roots, "doc_id", "left").select("doc_id", "n_shingles", "region", F.coalesce("root", "doc_id").alias("component")))

    for turn in range(STARS):
        found = cut_lineage(found.unionByName(_compared(docs, _stars(told(every), turn), width, percent)))
    found = cut_lineage(found.unionByName(_compared(docs, _whole(told(every.where("NOT crowded").unionByName(parts))), width, percent)))
    return links.unionByName(found).unionByName(_compared(docs, _blocks(told(every.where("crowded"))), width, percent))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; components of sets at least ``percent`` similar.

    Only doc_id and text are read, so other columns may have any name. Null, empty and word-free texts have no shingles and are
    linked with nothing. Rows without doc_id name no document and are left out. Rows that repeat a doc_id come out each; of
    differing texts under one doc_id any may stand for it. An empty table gives no rows. A component's id is its smallest doc_id.
    """
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    signed = cut_lineage(_signed(rows, width))
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    reps = reps.select("doc_id", "n_shingles", "signature")
    neighbours = _neighbours(reps)
    families = cut_lineage(_families(reps, neighbours))
    found = components(_links(rows, reps, neighbours, families, width, percent)).select(F.col("node").alias("rep"), F.col("root").alias("component"))
    of_class = classes.join(found, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    member = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = member.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
