"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers (``floor(SCALE * c)``). The covariance is that of the distinct vectors. It is never formed: distinct
vectors lie in blocks in the shared folder, and one distributed pass multiplies a few columns by it, ``(X - m)' ((X - m) Q) / n``,
centred before multiplying; tasks add up their blocks and Spark adds up the tasks, dimension by dimension. A three-term Chebyshev
recurrence over such passes damps the spectrum below the block's least Ritz value, QR makes the block orthonormal, and a
Rayleigh-Ritz step turns it. Residuals certify the wanted vectors: the iteration ends when residual over gap is at the precision of
doubles. A block that converges slowly is doubled, so it ends at the latest when it spans the space.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

SCALE = 256
COMPONENTS = 4
GUARD = 20  # further columns of the block, beyond the wanted ones
DEGREE = 12
SPREAD = 1e8  # the most by which a filter may stretch one wanted vector over another
VECTOR_ERROR = 1e-14
SLOW_CYCLES = 6  # a block is doubled when it is not certified after so many
BLOCK_ENTRIES = 1 << 20
PASS_BYTES = 1 << 26  # stored bytes of blocks that one task of a pass reads
LONG = 1 << 63


@dataclass
class Whitening:
    """``axes``: a unit eigenvector per column. ``values``: their eigenvalues, falling. ``sums``: exact, per dimension."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vector: Column) -> Column:
    """The vector in whole numbers; null if it is null or empty, or an entry is null, not finite or beyond a long."""
    scaled = F.transform(vector, lambda c: F.lit(float(SCALE)) * c.cast("double"))
    fine = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < float(LONG), F.lit(False)))  # NaN is greater than any number
    return F.when(fine & (F.size(scaled) > 0), F.transform(scaled, lambda c: F.floor(c)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole numbers."""
    exact = x if float(np.abs(x.astype("float64")).max(initial=0)) * len(x) < LONG / 2 else x.astype(object)
    return [int(v) for v in exact.sum(axis=0)]


def _blocks(batches):
    """Distinct vectors as blocks of equal width: rows of (width, n, sums, type, data)."""
    for batch in batches:
        column = batch.column(0)
        widths = np.diff(column.offsets.to_numpy())
        for width in np.unique(widths):
            x = _matrix(column.filter(pa.array(widths == width)), int(width))
            step = max(1, BLOCK_ENTRIES // int(width))
            rows = []
            for part in (x[i : i + step] for i in range(0, len(x), step)):
                kind = np.result_type(np.min_scalar_type(int(part.min())), np.min_scalar_type(int(part.max())), "int8")
                kind = kind if kind.kind == "i" else np.dtype("int64")
                rows.append((int(width), len(part), [str(v) for v in _total(part)], kind.str, part.astype(kind).tobytes()))
            names = ("width", "n", "sums", "type", "data")
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=_BLOCK_ARROW)


_BLOCK_ARROW = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("type", pa.string()), ("data", pa.binary())])
_BLOCK_SCHEMA = "width int, n long, sums array<string>, type string, data binary"


def _summed(blocks: DataFrame, mean: np.ndarray, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(X - mean)`` over all blocks. The driver gets ``shape`` numbers, whatever the number of tasks."""
    n_rows, n_columns = shape
    width = len(mean)
    names = [f"c{k}" for k in range(n_columns)]

    def tasks(batches):
        total = np.zeros(shape)
        for batch in batches:
            for kind, data in zip(batch.column("type").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), dtype=kind).reshape(-1, width)
                total += part(x.astype("float64") - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_rows, dtype="int32")), *map(pa.array, total.T.copy())], ["i", *names])

    partial = blocks.select("type", "data").mapInArrow(tasks, "i int, " + ", ".join(f"{c} double" for c in names))
    rows = partial.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    result = np.zeros(shape)
    for row in rows:
        result[row["i"]] = row[1:]
    return result


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of ``degree`` in the covariance, applied to ``q``; it stays within 1 on eigenvalues from 0 to ``cut``."""
    half = cut / 2
    before, now = q, (times(q) - half * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (times(now) - half * now) / half - before
    return now


def _stretch(value: float, cut: float) -> float:
    """The growth of an eigenvector per degree, as a logarithm."""
    return float(np.arccosh(max(2 * value / cut - 1, 1.0)))


def _leading(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenpairs of the product ``times``: values and unit vectors, certified by residuals."""
    rng = np.random.default_rng(11)
    size = min(width, wanted + GUARD)
    q = np.linalg.qr(rng.standard_normal((width, size)))[0]
    best, cycles = np.inf, 0
    while True:
        z = times(q)
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        residuals = np.linalg.norm(z - q * values, axis=0)[:wanted]
        ends = np.concatenate([values, [0.0]])
        gaps = [max(min(np.abs(np.delete(ends, j) - ends[j])), VECTOR_ERROR * values[0]) for j in range(wanted)]
        error = max(r / gap for r, gap in zip(residuals, gaps)) if values[0] > 0 else 0.0
        settled = residuals.max() <= 1e-9 * values[0] and error > best / 2  # at the rounding error of the passes
        if size == width or error <= VECTOR_ERROR or settled:
            order = np.sign(q[np.abs(q).argmax(axis=0), np.arange(size)])
            return values[:wanted], (q * order)[:, :wanted]
        best, cycles = min(best, error), cycles + 1
        if cycles % SLOW_CYCLES == 0:
            size = min(width, 2 * size)
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((width, size - q.shape[1]))]))[0]
            continue
        cut = max(values[-1], values[0] * 1e-12)
        apart = _stretch(values[0], cut) - _stretch(values[wanted - 1], cut)
        degree = int(max(1, min(DEGREE, np.log(SPREAD) / apart if apart > 0 else DEGREE)))
        q = np.linalg.qr(_filtered(times, q, cut, degree))[0]


def fit(rows: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows``; None if no vector remains.

    Vectors that are null, empty, or hold a null or non-finite entry (or one beyond a long) are left out, and so are those of
    another length than most of the distinct ones (ties: the greater length). Directions without variance get no component, so there
    are fewer than ``components`` in small or flat tables. Repeated rows count once. Ties between eigenvalues: any vectors of
    their plane. A table with a hot vector is no special case: map tasks merge equal vectors before they are shuffled.
    """
    distinct = rows.select(whole_numbers(F.col(vector)).alias("x")).where("x IS NOT NULL").distinct()
    blocks = cut_lineage(distinct.mapInArrow(_blocks, _BLOCK_SCHEMA))
    widths = blocks.groupBy("width").agg(F.sum("n").alias("n"), F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("blocks"))
    widest = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return None
    width, n = widest["width"], widest["n"]
    blocks = blocks.where(F.col("width") == width)
    totals = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in totals.orderBy("i").collect()]
    mean = np.array([s / n for s in sums])
    tasks = max(-(-widest["bytes"] // PASS_BYTES), rows.sparkSession.sparkContext.defaultParallelism)
    blocks = blocks.coalesce(int(min(tasks, widest["blocks"])))

    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _summed(blocks, mean, q.shape, lambda x: x.T @ (x @ q)) / n

    trace = float(_summed(blocks, mean, (1, 1), lambda x: np.array([[np.square(x).sum()]]))[0, 0]) / n
    values, axes = _leading(times, width, min(components, width))
    varied = values > 1e-12 * trace if trace > 0 else np.zeros(len(values), dtype=bool)
    values, axes = values[varied], axes[:, varied]
    error = 0.0
    if len(values):
        scaled = axes / np.sqrt(values)
        k = len(values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = x @ scaled
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = _summed(blocks, mean, (k + 1, k), moments) / n
        error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return Whitening(n, sums, axes, values, trace, error, passes)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 per row, exact; None beyond a long."""
    bound = n * float(np.abs(x.astype("float64")).max(initial=0)) + max(map(abs, sums), default=0)
    if bound * bound * x.shape[1] < LONG / 2:
        return np.square(n * x - np.array(sums, dtype="int64")).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < LONG else None for v in exact]


def whiten(rows: DataFrame, model: Whitening | None, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every remaining row under every component: vec_id, component (from 1), n, deviation (exact; null if it is beyond a long),
    whitened, explained, identity_error. Only the two named columns are read. Null and repeated ids stay as they are."""
    kind = dict(rows.select(vec_id).dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    mean, scaled = model.mean, model.axes / np.sqrt(model.values)
    shares, k, width = model.values / model.trace, len(model.values), len(model.sums)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviations = pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), len(x))),
                    pa.array(np.full(len(x) * k, model.n, dtype="int64")),
                    deviations,
                    pa.array(((x.astype("float64") - mean) @ scaled).ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(x) * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kept = rows.select(F.col(vec_id).alias("vec_id"), whole_numbers(F.col(vector)).alias("x")).where(F.size("x") == width)
    return kept.mapInArrow(project, schema)
