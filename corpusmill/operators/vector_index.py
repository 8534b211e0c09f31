"""A vector index of coarse cells, searched by the triangle inequality.

Unit vectors lie in the cell of their nearest centre, and each row knows its distance to it. A query first searches the cells nearest to it.
Its k-th best score then bounds what others must offer: a row of a cell with centre c and radius r is at least ``|q - c| - r`` away, so whole
cells drop out. What remains is searched too, so the answer is exact; with ``probes`` set, only the nearest cells are searched.

Centres are fitted on a bounded sample and written with the index; all rows are assigned. Cells are cut into blocks of bounded size and
queries too, and a task holds one of each, so neither a hot cell nor a large set of queries meets in one task, and nothing but the centres,
a row per cell, and ``k`` ids goes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, scratch_path

CELLS = 1_024  # the most cells of an index
SAMPLE_ROWS = 20_000  # vectors that centres are fitted on, chosen by hash
FIT_ROUNDS = 8
BLOCK_ROWS = 16_384
QUERY_BLOCK = 4_096
SCORES = 1 << 22  # scores that a task holds at once
SCORE_PLACES = 9
TIE_STEP = 1e-14
SLACK = 1e-6  # rounding of distances, so that no cell is dropped for it
NEAREST = 2  # cells searched before the bound is known, more where they hold fewer than k rows


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: cell, chunk_id, vector (of unit length), gap (distance to the centre). Cell -1 holds vectors of length zero."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    zeros: int

    @property
    def blocks(self) -> list[int]:
        return [max(1, -(-int(n) // BLOCK_ROWS)) for n in self.counts]


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds over a bounded sample; starts at its first different vectors, so reruns agree."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:cells]]
    for _ in range(FIT_ROUNDS):
        nearest = _distances(sample, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def write_vector_index(chunks: DataFrame, path: str, *, cells: int | None = None) -> VectorIndex:
    """Index all rows of ``chunks`` (chunk_id, vector) below ``path``: folders ``rows`` (by cell) and ``cells``.

    ``cells`` defaults to the square root of the number of rows, ``CELLS`` at most. Rows without a vector are left out. All vectors have one length.
    """
    spark = chunks.sparkSession
    chunks = chunks.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL AND size(vector) > 0")
    if cells is None:
        cells = int(min(CELLS, max(1, chunks.count() ** 0.5)))
    sample = chunks.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE_ROWS).select("vector").toArrow()
    units = _unit(_matrix(sample.column(0)))
    units = units[(units != 0).any(axis=1)]
    centres = fit_centres(units, cells) if len(units) else np.zeros((0, max(1, units.shape[1])))

    def assign(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column("vector")))
            if not len(x):
                continue
            zero = ~(x != 0).any(axis=1)
            d = _distances(x, centres) if len(centres) else np.zeros((len(x), 1))
            cell = np.where(zero, -1, d.argmin(axis=1)).astype("int32")
            gap = np.where(zero, 0.0, d.min(axis=1))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype="int32")), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("chunk_id"), vectors, pa.array(gap)], ["cell", "chunk_id", "vector", "gap"])

    kind = dict(chunks.dtypes)["chunk_id"]
    placed = chunks.mapInArrow(assign, f"cell int, chunk_id {kind}, vector array<double>, gap double")
    placed.repartitionByRange("cell", "chunk_id").write.partitionBy("cell").parquet(f"{path}/rows")
    rows = _rows(spark, path, kind)
    stats = {r["cell"]: r for r in rows.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}
    table = [(-1, [], 0.0, stats[-1]["n"])] if -1 in stats else []
    for cell, centre in enumerate(centres):
        found = stats.get(cell)
        table.append((cell, centre.tolist(), found["radius"] if found else 0.0, found["n"] if found else 0))
    # The null chunk_id tells the type of ids, also for an empty index.
    schema = f"cell int, centre array<double>, radius double, n long, chunk_id {kind}"
    spark.createDataFrame([(*r, None) for r in table], schema).coalesce(1).write.parquet(f"{path}/cells")
    return read_vector_index(spark, path)


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"chunk_id {kind}, vector array<double>, gap double, cell int").parquet(f"{path}/rows")


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    stored = spark.read.parquet(f"{path}/cells")
    table = stored.orderBy("cell").collect()  # CELLS rows and one at most
    cells = [r for r in table if r["cell"] >= 0]
    rows = _rows(spark, path, dict(stored.dtypes)["chunk_id"])
    centres = np.array([r["centre"] for r in cells]) if cells else np.zeros((0, 1))
    zeros = sum(r["n"] for r in table if r["cell"] < 0)
    return VectorIndex(rows, centres, np.array([r["radius"] for r in cells]), np.array([r["n"] for r in cells], dtype="int64"), zeros)


def _nearest_cells(d: np.ndarray, counts: np.ndarray, k: int, probes: int) -> np.ndarray:
    """A mask of each query's nearest filled cells: ``probes`` of them, and more until they hold ``k`` rows."""
    d = np.where(counts > 0, d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1) - counts[order]
    taken = (np.arange(d.shape[1]) < probes) | (held < k)
    mask = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(mask, order, taken, axis=1)
    return mask & (counts > 0)


def _asked(queries: DataFrame, index: VectorIndex, k: int, probes: int, worst: bool) -> DataFrame:
    """Rows of (cell, block, query_id, vector, centre distance): the nearest cells, or with ``worst`` the others that may still hold a better row."""
    centres, radius, counts = index.centres, index.radius, index.counts
    blocks = np.array(index.blocks, dtype="int64")
    kind = dict(queries.dtypes)["query_id"]

    def expand(batches):
        for batch in batches:
            q = _unit(_matrix(batch.column("vector")))
            known = np.flatnonzero((q != 0).any(axis=1))
            if not len(known) or not len(centres):
                continue
            d = _distances(q[known], centres)
            mask = _nearest_cells(d, counts, k, probes)
            if worst:
                near = np.maximum(d - radius - SLACK, 0)
                needed = np.nan_to_num(batch.column("worst").to_numpy(zero_copy_only=False).astype("float64")[known], nan=-2.0)
                mask = ~mask & (counts > 0) & (1 - near * near / 2 >= needed[:, None] - SLACK)
            row, cell = np.nonzero(mask)
            times = blocks[cell]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, cell = np.repeat(known[row], times), np.repeat(cell, times)
            for at in range(0, len(row), 10_000):
                part = slice(at, at + 10_000)
                x = q[row[part]]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype="int32")), pa.array(x.ravel()))
                ids = batch.column("query_id").take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[part].astype("int32")), pa.array(block[part].astype("int32")), ids, vectors], ["cell", "block", "query_id", "vector"])

    return queries.mapInArrow(expand, f"cell int, block int, query_id {kind}, vector array<double>")


def _searched(index: VectorIndex, asked: DataFrame, k: int, query_blocks: int) -> DataFrame:
    """The k best rows (query_id, chunk_id, score) of each query in each block that it asks."""
    spark = asked.sparkSession
    kinds = dict(index.rows.dtypes)["chunk_id"], dict(asked.dtypes)["query_id"]
    sizes = spark.createDataFrame(list(enumerate(index.blocks)), "cell int, blocks int")  # CELLS rows at most
    held = index.rows.where("cell >= 0").join(F.broadcast(sizes), "cell")
    held = held.withColumn("block", F.expr("pmod(xxhash64(chunk_id), blocks)").cast("int"))
    held = held.select("cell", "block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "chunk_id", "vector")
    wanted = asked.withColumn("part", F.expr(f"pmod(xxhash64(query_id), {query_blocks})").cast("int"))
    held = held.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # CELLS rows at most
    names = ["query_id", "chunk_id", "score"]

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        query_at, row_at, scores = [], [], []
        if queries.num_rows and rows.num_rows:
            ids = rows.column("chunk_id").combine_chunks()
            order = pc.sort_indices(ids).to_numpy(zero_copy_only=False)
            x, q = _matrix(rows.column("vector"))[order], _matrix(queries.column("vector"))
            step = max(1, SCORES // len(x))
            for at in range(0, len(q), step):
                line = np.round(q[at : at + step] @ x.T, SCORE_PLACES)
                # Rows are in the order of their ids; steps far below the last place of a score settle ties by it.
                key = np.arange(len(x)) * TIE_STEP - line
                top = np.argpartition(key, k - 1, axis=1)[:, :k] if len(x) > k else np.broadcast_to(np.arange(len(x)), line.shape)
                top = np.take_along_axis(top, np.take_along_axis(key, top, axis=1).argsort(axis=1), axis=1)
                query_at.append(np.repeat(np.arange(at, at + len(line)), top.shape[1]))
                row_at.append(order[top].ravel())
                scores.append(np.take_along_axis(line, top, axis=1).ravel())
        flat = [np.concatenate(v) if v else np.array([], dtype="int64") for v in (query_at, row_at)]
        found = np.concatenate(scores) if scores else np.array([], dtype="float64")
        columns = [queries.column("query_id").take(pa.array(flat[0])), rows.column("chunk_id").take(pa.array(flat[1])), pa.chunked_array([pa.array(found)])]
        return pa.Table.from_arrays(columns, names)

    keys = ["cell", "block", "part"]
    return wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _without_length(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """Hits of score 0: the first ids for a query of length zero, and the first rows of length zero for any query."""
    kinds = dict(index.rows.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    first = [r[0] for r in index.rows.select("chunk_id").orderBy("chunk_id").limit(k).collect()]
    empty = [r[0] for r in index.rows.where("cell = -1").select("chunk_id").orderBy("chunk_id").limit(k).collect()] if index.zeros else []
    is_zero = ~F.exists("vector", lambda c: c != 0)
    named = lambda ids: F.array(*map(F.lit, ids)).cast(f"array<{kinds[0]}>")
    ids = F.when(is_zero, named(first)).otherwise(named(empty))
    return queries.select("query_id", F.explode(ids).alias("chunk_id"), F.lit(0.0).alias("score"))


def search(index: VectorIndex, queries: DataFrame, *, k: int, probes: int | None = None) -> DataFrame:
    """The ``k`` rows nearest by cosine for every query: query_id, chunk_id, score, rank; ties go by chunk_id.

    Exact, or with ``probes`` only over so many nearest cells of each query. A vector of length zero has score 0 with all others. Queries without
    a vector get no hits. Query ids are unique.
    """
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL AND size(vector) > 0")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    near = _searched(index, _asked(queries, index, k, probes or NEAREST, False), k, query_blocks)
    near = _ranked(near, k).drop("rank")
    blank = _without_length(index, queries, k)
    if probes is not None:
        return _ranked(near.unionByName(blank), k)
    near = cut_lineage(near)
    worst = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    bounded = queries.join(worst, "query_id", "left")
    far = _searched(index, _asked(bounded, index, k, NEAREST, True), k, query_blocks)
    return _ranked(near.unionByName(far).unionByName(blank), k)


def build_vector_index(chunks: DataFrame, *, cells: int | None = None) -> VectorIndex:
    """An index in the shared folder, for one job."""
    return write_vector_index(chunks, scratch_path(chunks.sparkSession, "vector-index"), cells=cells)
