"""Least squares and leading directions of wide or sparse rows, without their moment matrix.

Only products ``X'(X V)`` with a few columns are formed, one distributed pass each: a task
multiplies its own rows out and back and hands on one tall, narrow sum; Spark adds the sums.
On the driver are blocks of features x columns, whatever the number of rows. A space of
such columns grows block by block, always by what is not solved yet, so the number of
passes follows how hard the problem is, not how many features there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tollgate.session import BROADCAST_LIMIT_BYTES, written

# A sparse row: its width, and the places and values that are not zero.
SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
# Cells of the dense part of one chunk of rows, and its rows.
CHUNK = 4_000_000
CHUNK_ROWS = 16_384
# A column is dense where at least one row in so many holds it: products of entries cost that much more.
OFTEN = 16
# Doubles in one row of a task's sum.
PIECE = 8_192
# Columns that a space may hold before it is restarted from what it has found.
MOST_COLUMNS = 640
MOST_PASSES = 600
# Columns by which the search for directions grows: fewer follow the residuals better.
GROWTH = 32
DIRECTION_TOLERANCE = 1e-9
SOLUTION_TOLERANCE = 1e-11


def is_sparse(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, StructType)


def row_width(df: DataFrame, column: str = "x") -> int | None:
    """Features of a row, None without rows."""
    size = F.col(column)["size"] if is_sparse(df, column) else F.size(column)
    row = df.select(size.alias("d")).first()
    return None if row is None else row.d


def targets() -> Column:
    """Performances, then costs; missing ones count as zero."""
    both = F.concat(F.col("perf").cast("array<double>"), F.col("cost").cast("array<double>"))
    return F.transform(both, lambda y: F.coalesce(F.nanvl(y, F.lit(0.0)), F.lit(0.0)))


class _Chunk:
    """Some rows by their entries: columns that many rows hold as a dense matrix, the rest by row and by column."""

    def __init__(self, ends: np.ndarray, indices: np.ndarray, values: np.ndarray):
        sizes = np.diff(ends)
        self.n = len(sizes)
        rows = np.repeat(np.arange(self.n, dtype="i4"), sizes)
        indices, values = indices[ends[0] : ends[-1]], values[ends[0] : ends[-1]]
        columns, place, count = np.unique(indices, return_inverse=True, return_counts=True)
        often = count * OFTEN >= self.n
        at = often[place]
        self.often = columns[often]
        self.cells = (rows[at], (np.cumsum(often) - 1)[place[at]].astype("i4"), values[at])
        rows, indices, values = rows[~at], indices[~at], values[~at]
        self.held, self.starts = np.unique(rows, return_index=True)
        self.indices, self.values = indices, values
        order = np.argsort(indices, kind="stable")
        self.back_rows, self.back_values = rows[order], values[order]
        self.touched, self.groups = np.unique(indices[order], return_index=True)

    @staticmethod
    def restored(arrays: dict) -> _Chunk:
        chunk = _Chunk.__new__(_Chunk)
        vars(chunk).update(arrays)
        return chunk

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, len(self.often)))
        rows, columns, values = self.cells
        out[rows, columns] = values
        return out

    def times(self, v: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
        """Rows times the columns of ``v``."""
        out = (self.dense() if dense is None else dense) @ v[self.often]
        if len(self.held):
            for j in range(v.shape[1]):
                out[self.held, j] += np.add.reduceat(self.values * np.ascontiguousarray(v[:, j])[self.indices], self.starts)
        return out

    def add_back(self, p: np.ndarray, out: np.ndarray, dense: np.ndarray | None = None) -> None:
        """Add the transposed rows times ``p``."""
        out[self.often] += (self.dense() if dense is None else dense).T @ p
        if len(self.held):
            for j in range(p.shape[1]):
                parts = self.back_values * np.ascontiguousarray(p[:, j])[self.back_rows]
                out[self.touched, j] += np.add.reduceat(parts, self.groups)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, places and values of a batch of sparse or dense rows."""
    if pa.types.is_struct(column.type):
        indices, values = column.field("indices"), column.field("values")
        ends = indices.offsets.to_numpy().astype("i8")
        return ends - ends[0], indices.flatten().to_numpy(), values.flatten().to_numpy()
    ends = column.offsets.to_numpy().astype("i8")
    ends = ends - ends[0]
    return ends, np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends)), column.flatten().to_numpy()


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[tuple[slice, _Chunk]]:
    ends, indices, values = _entries(batch.column("x"))
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        to = min(to, at + CHUNK_ROWS)
        yield slice(at, to), _Chunk(ends[at : to + 1], indices, values)
        at = to


def _most() -> int:
    """Entries of a chunk: its dense part stays within ``CHUNK`` cells."""
    return max(1, CHUNK // OFTEN)


def _summed(chunks: DataFrame, shape: tuple[int, int], add: Callable[[_Chunk, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of a matrix to which each adds its chunks and their targets."""
    size = shape[0] * shape[1]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros(shape), False
        for batch in batches:
            for packed in batch.column("chunk"):
                seen = True
                arrays, y = pickle.loads(packed.as_buffer())
                add(_Chunk.restored(arrays), y, out)
        flat = out.ravel()
        for at in range(0, size if seen else 0, PIECE):
            yield pa.RecordBatch.from_pydict({"i": pa.array([at // PIECE], pa.int32()), "part": [flat[at : at + PIECE]]})

    # sums are as large as the features, so there are only as many as work side by side
    few = chunks.coalesce(max(1, chunks.sparkSession.sparkContext.defaultParallelism))
    parts = few.mapInArrow(total, "i int, part array<double>")
    pieces = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("part")).alias("part")).collect()
    flat = np.zeros(size)
    for r in pieces:
        flat[r["i"] * PIECE : (r["i"] + 1) * PIECE] = r["part"].toArray()
    return flat.reshape(shape)


@dataclass(frozen=True)
class WideRows:
    """Rows ``x`` (sparse or dense) with targets ``y``, sorted into chunks once and read once per product."""

    chunks: DataFrame
    width: int
    targets: int

    @staticmethod
    def of(df: DataFrame, y: Column | None = None) -> WideRows:
        """Targets are ``perf`` and ``cost`` without what is missing, or ``y`` as it stands."""
        width = row_width(df)
        if width is None:
            raise ValueError("no train rows")
        x = F.col("x") if is_sparse(df, "x") else F.col("x").cast("array<double>")
        rows, most = df.select(x.alias("x"), (targets() if y is None else y).alias("y")), _most()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column("y").flatten().to_numpy().reshape(batch.num_rows, -1)
                for part, chunk in _chunks(batch, most):
                    packed = pickle.dumps((vars(chunk), y[part]), protocol=5)
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([packed], pa.binary())})

        count = rows.select(F.size("y").alias("m")).first().m
        return WideRows(written(rows.mapInArrow(pack, "chunk binary"), "chunks"), width, count)

    def gram_times(self, v: np.ndarray) -> np.ndarray:
        """``X'(X v)``; more columns than can be sent to the workers at once take several passes."""
        most = max(1, BROADCAST_LIMIT_BYTES // (8 * self.width))
        return np.hstack([self._pass(v[:, at : at + most]) for at in range(0, v.shape[1], most)])

    def _pass(self, v: np.ndarray) -> np.ndarray:
        shared = self.chunks.sparkSession.sparkContext.broadcast(v)

        def add(chunk: _Chunk, y: np.ndarray, out: np.ndarray) -> None:
            dense = chunk.dense()
            chunk.add_back(chunk.times(shared.value, dense), out, dense)

        try:
            return _summed(self.chunks, v.shape, add)
        finally:
            shared.unpersist()

    def sums(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, their sum, the sum of the targets, and ``X'Y``."""

        def add(chunk: _Chunk, y: np.ndarray, out: np.ndarray) -> None:
            y = np.column_stack([np.ones(len(y)), y])
            out[-1] += y.sum(0)
            chunk.add_back(y, out[:-1])

        total = _summed(self.chunks, (self.width + 1, self.targets + 1), add)
        return total[-1, 0], total[:-1, 0], total[-1, 1:], total[:-1, 1:]


class GramSpace:
    """Orthonormal columns ``v`` with their products ``av``."""

    def __init__(self, product: Callable[[np.ndarray], np.ndarray], width: int):
        self.product, self.passes, self.width = product, 0, width
        self.restart()

    def restart(self) -> None:
        self.v = self.av = np.zeros((self.width, 0))
        self.h = np.zeros((0, 0))

    def grow(self, block: np.ndarray) -> bool:
        """Take up what is new in ``block``; False if nothing is."""
        lengths = np.linalg.norm(block, axis=0)
        block = block[:, lengths > 0] / lengths[lengths > 0]
        for _ in range(2):
            block = block - self.v @ (self.v.T @ block)
        if not block.shape[1]:
            return False
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        new = left[:, size > 1e-10]
        new = new - self.v @ (self.v.T @ new)
        new = np.linalg.qr(new)[0] if new.shape[1] else new
        if not new.shape[1]:
            return False
        if self.passes >= MOST_PASSES:
            raise RuntimeError(f"not solved after {MOST_PASSES} passes over the rows")
        self.passes += 1
        product = self.product(new)
        # only what is new is multiplied out: the rest of v'Av stays
        side, corner = self.v.T @ product, new.T @ product
        self.h = np.block([[self.h, side], [side.T, (corner + corner.T) / 2]])
        self.v, self.av = np.hstack([self.v, new]), np.hstack([self.av, product])
        return True

    def projected(self) -> np.ndarray:
        return self.h

    def keep(self, mix: np.ndarray) -> None:
        self.v, self.av = self.v @ mix, self.av @ mix
        h = self.v.T @ self.av
        self.h = (h + h.T) / 2


def leading_directions(rows: WideRows, rank: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest squared singular values and their right singular vectors.

    A block Krylov search with random start (Musco and Musco 2015), each time grown by the
    residuals of the directions that are least settled, and cut back to the best found when
    it is full, beyond the wanted ones to three fifths. Fewer come back only if the rows
    have fewer directions.
    """
    draw = np.random.default_rng(seed)
    space = GramSpace(rows.gram_times, rows.width)
    growth = min(GROWTH, rows.width)
    most = max(MOST_COLUMNS, 2 * (rank + growth))
    kept = max(rank + growth, min(3 * most // 5, most - growth))
    going = space.grow(rows.gram_times(draw.standard_normal((rows.width, growth))))
    while True:
        values, mix = np.linalg.eigh(space.projected())
        values, mix = values[::-1], mix[:, ::-1]
        k = min(rank, len(values))
        vectors = space.v @ mix[:, :k]
        left = space.av @ mix[:, :k] - vectors * values[:k]
        error = np.linalg.norm(left, axis=0)
        settled = k == rank and error.max(initial=0) <= DIRECTION_TOLERANCE * values[0]
        if settled or not going:
            found = values[:k] > DIRECTION_TOLERANCE * max(values[0], 0) if k else np.zeros(0, bool)
            return values[:k][found], vectors[:, found]
        if space.v.shape[1] + growth > most:
            space.keep(mix[:, :kept])
        going = space.grow(left[:, np.argsort(-error)[:growth]])


def least_squares(rows: WideRows) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept of least squares; of several solutions the shortest.

    The solution is sought in the space of the products of ``X'Y``, grown by what the
    normal equations leave over (conjugate gradients, all targets in one space).
    """
    n, x_sum, y_sum, xy = rows.sums()
    x_mean, y_mean = x_sum / n, y_sum / n
    wanted = xy - np.outer(x_sum, y_mean)

    def centred(v: np.ndarray) -> np.ndarray:
        return rows.gram_times(v) - np.outer(x_sum, x_mean @ v)

    space = GramSpace(centred, rows.width)
    weights, rest = np.zeros_like(wanted), wanted
    size = np.maximum(np.linalg.norm(wanted, axis=0), np.finfo(float).tiny)
    while True:
        open_ = np.linalg.norm(rest, axis=0) > SOLUTION_TOLERANCE * size
        if not open_.any():
            break
        if space.v.shape[1] + open_.sum() > MOST_COLUMNS:
            # a new space for what is left over; what is solved stays
            weights, wanted = weights + space.v @ solution, rest
            space.restart()
        if not space.grow(rest[:, open_]):
            break
        solution = np.linalg.lstsq(space.projected(), space.v.T @ wanted, rcond=1e-13)[0]
        rest = wanted - space.av @ solution
    if space.v.shape[1]:
        weights = weights + space.v @ solution
    return weights, y_mean - x_mean @ weights


def low_rank_ridge(rows: WideRows, rank: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, intercept and directions of ridge regression on the leading directions."""
    n, x_sum, y_sum, xy = rows.sums()
    values, vectors = leading_directions(rows, max(1, min(rank, int(n), rows.width)))
    z_mean, y_mean = vectors.T @ x_sum / n, y_sum / n
    penalised = np.diag(values) - n * np.outer(z_mean, z_mean) + alpha * np.eye(len(values))
    solution = np.linalg.solve(penalised, vectors.T @ xy - n * np.outer(z_mean, y_mean))
    weights = vectors @ solution
    return weights, y_mean - (x_sum / n) @ weights, vectors


def row_times(x: str, matrix: np.ndarray, df: DataFrame) -> Column:
    """``x`` of every row of ``df`` times a matrix, an array; the matrix is sent out once."""
    if matrix.nbytes > BROADCAST_LIMIT_BYTES:
        raise ValueError(f"a matrix of {matrix.nbytes} bytes is too large to be sent to every worker")
    shared, most = df.sparkSession.sparkContext.broadcast(matrix), _most()

    @F.arrow_udf("array<double>")
    def times(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), shared.value.shape[1]))
        batch = pa.RecordBatch.from_arrays([column], names=["x"])
        for part, chunk in _chunks(batch, most):
            out[part] = chunk.times(shared.value)
        ends = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, out.ravel())

    return times.asNondeterministic()(F.col(x))
