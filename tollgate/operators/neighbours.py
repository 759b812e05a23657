"""Exact k-nearest-neighbour search of test vectors among train vectors."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tollgate.session import fits_broadcast, once, shuffle_partitions, written

log = logging.getLogger(__name__)

# Distances are compared to this many decimals; equal ones go by train id.
DECIMALS = 12

# Largest number of distances held at once by a task.
_MATRIX_CELLS = 4_000_000

# Most pivots of the shuffled search, and pivots per block of train rows.
PIVOTS = 1_024
PIVOTS_PER_BLOCK = 8

# Test rows that a task compares with all pivots at once.
ROUTED_ROWS = 1_024

# What rounding may take from a bound, relative to the lengths involved; only makes cells stay.
SLACK = 1e-6

# Bundles of cells that a train side is dealt into, unless memory asks for more.
BUNDLES = 4

# Size of a block in the shuffled search.
BLOCK_ROWS = 50_000
BLOCK_BYTES = 64 * 1024 * 1024


def _unit(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(lengths > 0, lengths, 1.0)


def _distances(test: np.ndarray, train: np.ndarray, metric: str) -> np.ndarray:
    """Rounded distances; for cosine both sides are of unit length."""
    if metric == "cosine":
        out = 1.0 - test @ train.T
    else:
        out = np.zeros((len(test), len(train)))
        for j in range(train.shape[1]):
            out += (test[:, j, None] - train[None, :, j]) ** 2
        np.sqrt(out, out=out)
    return np.round(out, DECIMALS)


def _nearest_straight(test: np.ndarray, train: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest by straight distance.

    One product bounds all squared distances; only rows that may be among the k by that
    bound get their exact distance, summed as in ``_distances``.
    """
    a, b = (test * test).sum(axis=1), (train * train).sum(axis=1)
    square = a[:, None] + b - 2 * test @ train.T
    off = 8 * np.finfo(float).eps * (train.shape[1] + 4) * (np.sqrt(a) + np.sqrt(b.max())) ** 2
    kth = np.partition(square, k - 1, axis=1)[:, k - 1]
    most = (np.sqrt(np.maximum(kth + off, 0.0)) + 4 * 10.0**-DECIMALS) ** 2 + off
    row, at = np.nonzero(~(square > most[:, None]))
    exact = np.zeros(len(row))
    for j in range(train.shape[1]):
        exact += (test[row, j] - train[at, j]) ** 2
    exact = np.round(np.sqrt(exact), DECIMALS)
    order = np.lexsort((at, exact, row))
    first = np.searchsorted(row, np.arange(len(test)))
    picked = order[first[:, None] + np.arange(k)]
    return at[picked], exact[picked]


def top_k(test: np.ndarray, train: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of test rows: positions and distances of the k nearest.

    ``train`` is in id order, so among equal distances the first position wins.
    """
    k = min(k, len(train))
    step = max(1, _MATRIX_CELLS // max(1, len(train)))
    if metric == "cosine":  # once, not for every slice
        test, train = _unit(test), _unit(train)
    for start in range(0, len(test), step):
        if metric == "euclidean" and np.isfinite(test).all() and np.isfinite(train).all():
            yield _nearest_straight(test[start : start + step], train, k)
            continue
        dist = _distances(test[start : start + step], train, metric)
        near = np.argpartition(dist, k - 1, axis=1)[:, :k]
        limit = np.take_along_axis(dist, near, axis=1).max(axis=1)
        near = np.sort(near, axis=1)
        order = np.argsort(np.take_along_axis(dist, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        tied = np.flatnonzero((dist <= limit[:, None]).sum(axis=1) > k)
        for r in tied:
            near[r] = np.argsort(dist[r], kind="stable")[:k]
        yield near, np.take_along_axis(dist, near, axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _placed(x: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Points whose straight distances bound the metric: unit vectors for cosine.

    A zero vector is at cosine distance 1 from all others, hence on an axis of its side.
    """
    if metric != "cosine":
        return x
    x = _unit(x)
    own = np.zeros((len(x), 2))
    own[~x.any(axis=1), side] = 1.0
    return np.hstack([x, own])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _nearest(points: np.ndarray, pivots: np.ndarray) -> pd.DataFrame:
    """Number and distance of the nearest pivot."""
    away = _apart(points, pivots)
    return pd.DataFrame({"cell": away.argmin(axis=1).astype("i4"), "away": away.min(axis=1)})


def _in_slices(of, *columns: np.ndarray) -> list:
    """Results of ``of`` on slices of the rows, which bounds its matrices."""
    starts = range(0, len(columns[0]), ROUTED_ROWS)
    return [of(*(c[i : i + ROUTED_ROWS] for c in columns)) for i in starts]


class Cells:
    """Voronoi cells of train rows around pivots: how many rows, and how far they reach.

    Neighbouring cells make up bundles of at most ``most`` rows, or of one larger cell: a
    test row goes to a bundle once, however many of its cells may matter.
    """

    def __init__(self, pivots: np.ndarray, metric: str, count: np.ndarray, reach: np.ndarray, most: int):
        self.metric, self.count, self.reach = metric, count, reach
        self.pivots = _placed(pivots, metric, 0)
        self.between = _apart(self.pivots, self.pivots)
        self.bundle = self._bundles(most)
        self.load = np.bincount(self.bundle, weights=count).astype(int)

    def _bundles(self, most: int) -> np.ndarray:
        """The bundle of every cell: the first free one with the nearest free ones that fit in."""
        bundle, number = np.full(len(self.count), -1), 0
        while (bundle < 0).any():
            start = int((bundle < 0).argmax())
            near = np.argsort(self.between[start], kind="stable")
            near = np.concatenate([[start], near[(bundle[near] < 0) & (near != start)]])
            fit = max(1, int((np.cumsum(self.count[near]) <= most).sum()))
            bundle[near[:fit]] = number
            number += 1
        return bundle

    def first(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """Per test row the bundles of the nearest cells that together hold ``k`` train rows."""
        order = np.argsort(_apart(_placed(x, self.metric, 1), self.pivots), axis=1, kind="stable")
        upto = (np.cumsum(self.count[order], axis=1) < k).sum(axis=1) + 1
        return [np.unique(self.bundle[row[:n][self.count[row[:n]] > 0]]) for row, n in zip(order, upto)]

    def other(self, x: np.ndarray, k: int, bound: np.ndarray) -> list[np.ndarray]:
        """Per test row the bundles beyond the first with a cell that may hold a row within ``bound``.

        A row of a cell is at least as far as the pivot less the cell's reach, and at least
        as far as the plane between the cell's pivot and the one nearest to the test row.
        """
        points = _placed(x, self.metric, 1)
        away = _apart(points, self.pivots)
        home = away.argmin(axis=1)
        least = away - self.reach
        between = self.between[home]
        square = away**2 - away.min(axis=1)[:, None] ** 2
        plane = np.divide(square, 2 * between, out=np.zeros_like(square), where=between > SLACK)
        scale = 1.0 + np.abs(points).max(axis=1, initial=0.0) + np.abs(self.pivots).max(initial=0.0)
        limit = np.sqrt(2 * (bound + 1e-11)) if self.metric == "cosine" else bound + 1e-11
        near = ~(np.maximum(least, plane) > (limit + SLACK * scale)[:, None]) & (self.count > 0)
        return [np.setdiff1d(self.bundle[row], done) for row, done in zip(near, self.first(x, k))]


def _block(row: str, blocks: Column) -> Column:
    # an integer like the exploded block numbers: both sides must hash alike
    return F.pmod(F.xxhash64(row), blocks).cast("int")


def _check_metric(metric: str) -> None:
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"metric must be 'cosine' or 'euclidean', not {metric!r}")


class NeighbourIndex:
    """Train vectors with their outcomes, ready for searches.

    A train side whose counted size fits the broadcast limit goes to the workers
    whole and the test side is not shuffled at all. A larger one is dealt into cells
    around pivots, neighbouring cells into bundles. Every distinct test vector is searched in
    the bundles of the nearest cells that hold k rows; its k-th distance then tells which other
    cells can matter, by the triangle inequality. A bundle holds ``block_rows`` rows, or the
    part of ``BUNDLES`` of the train side if that is more and fits a block: small blocks must
    not make pairs of blocks, and k candidates of each, grow with the square of the rows. Both sides of
    a bundle are cut into blocks of bounded size. ``sent`` counts the rows that went to blocks.
    """

    def __init__(
        self,
        train: DataFrame,
        k: int,
        metric: str = "cosine",
        broadcast: bool | None = None,
        block_rows: int = BLOCK_ROWS,
    ):
        _check_metric(metric)
        train = train.select(
            F.col("item_id").alias("train_id"),
            F.col("x").cast("array<double>").alias("x"),
            F.col("perf").cast("array<double>").alias("perf"),
            F.col("cost").cast("array<double>").alias("cost"),
        )
        self.train = written(train, "knn-train")
        size = self.train.agg(
            F.count(F.lit(1)), F.max(F.size("x")), F.max(F.size("perf"))
        ).first()
        self.rows, self.models = size[0], size[2]
        if not self.rows:
            raise ValueError("the neighbour search needs train rows")
        if k > self.rows:
            log.warning("k=%d is more than the %d train rows; all of them are taken", k, self.rows)
        self.k, self.metric = min(k, self.rows), metric
        row_bytes = 8 * (size[1] + 2 * size[2] + 1)
        self.most_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes))
        self.block_rows = max(1, min(block_rows, BLOCK_BYTES // row_bytes))
        self.bundle_rows = max(self.block_rows, min(self.most_rows, math.ceil(self.rows / BUNDLES)))
        fits = fits_broadcast(self.rows, row_bytes)
        self.broadcast = fits if broadcast is None else broadcast
        self._shared = None
        self._cells = None
        self.width = size[1]
        self.sent = {"train": 0, "test": 0}

    def _side(self):
        if self._shared is None:
            pdf = self.train.toPandas().sort_values("train_id", kind="stable")
            side = (
                pdf["train_id"].to_numpy(),
                _matrix(pdf["x"]),
                np.hstack([_matrix(pdf["perf"]), _matrix(pdf["cost"])]),
            )
            self._shared = self.train.sparkSession.sparkContext.broadcast(side)
        return self._shared

    def neighbours(self, test: DataFrame) -> DataFrame:
        """``(item_id, rank, train_id, distance)``, nearest first."""
        if not self.broadcast:
            rows, best = self._candidates(test)
            return rows.select("item_id", "_q").join(best, "_q").select("item_id", "rank", "train_id", "distance")
        side, k, metric = self._side(), self.k, self.metric

        @F.pandas_udf("struct<train_id:array<bigint>,distance:array<double>>")
        def search(x: pd.Series) -> pd.DataFrame:
            ids, train, _ = side.value
            found = list(top_k(_matrix(x), train, k, metric)) if len(x) else []
            return pd.DataFrame(
                {
                    "train_id": [row for near, _ in found for row in ids[near]],
                    "distance": [row for _, dist in found for row in dist],
                }
            )

        return (
            test.select("item_id", once(search)(F.col("x").cast("array<double>")).alias("found"))
            .select("item_id", F.posexplode(F.arrays_zip("found.train_id", "found.distance")).alias("pos", "n"))
            .select(
                "item_id",
                (F.col("pos") + 1).alias("rank"),
                F.col("n.train_id").alias("train_id"),
                F.col("n.distance").alias("distance"),
            )
        )

    def predict(self, test: DataFrame) -> DataFrame:
        """Add the neighbour means ``perf_pred`` and ``cost_pred``, missing values left out."""
        if not self.broadcast:
            return self._predict_blocks(test)
        side, k, metric = self._side(), self.k, self.metric

        @F.pandas_udf("array<double>")
        def means(x: pd.Series) -> pd.Series:
            _, train, targets = side.value
            out = []
            for near, _ in top_k(_matrix(x), train, k, metric):
                picked = targets[near]
                known = ~np.isnan(picked)
                count = known.sum(axis=1)
                total = np.where(known, picked, 0.0).sum(axis=1)
                out += list(np.where(count > 0, total / np.maximum(count, 1), np.nan))
            return pd.Series(out)

        m = self.models
        return (
            test.withColumn("_means", once(means)(F.col("x").cast("array<double>")))
            .withColumns(
                {
                    "perf_pred": F.slice("_means", 1, m),
                    "cost_pred": F.slice("_means", m + 1, m),
                }
            )
            .drop("_means")
        )

    def _pivots(self) -> np.ndarray:
        """Distinct train vectors, the first by a hash among a sample by the same hash."""
        wanted = min(PIVOTS, PIVOTS_PER_BLOCK * math.ceil(self.rows / self.block_rows), BLOCK_BYTES // (8 * self.width + 8))
        space = 1 << 40
        share = math.ceil(space * min(1.0, 16 * wanted / self.rows))
        keyed = self.train.select("x", F.xxhash64("x").alias("key"))
        some = keyed.where(F.pmod("key", F.lit(space)) < share).groupBy("key").agg(F.first("x").alias("x"))
        rows = some.orderBy("key").limit(max(1, wanted)).collect() or self.train.select("x").limit(1).collect()
        return np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), -1)

    def _by_cell(self) -> tuple[DataFrame, Cells]:
        """Train rows with their cell, and the cells."""
        if self._cells is None:
            pivots, metric = self._pivots(), self.metric
            shared = self.train.sparkSession.sparkContext.broadcast(_placed(pivots, metric, 0))

            @F.pandas_udf("struct<cell:int,away:double>")
            def nearest(x: pd.Series) -> pd.DataFrame:
                parts = _in_slices(lambda some: _nearest(_placed(some, metric, 0), shared.value), _matrix(x))
                return pd.concat(parts) if parts else pd.DataFrame({"cell": [], "away": []})

            rows = self.train.withColumn("_row", F.monotonically_increasing_id())
            rows = rows.withColumn("at", once(nearest)("x")).select("*", "at.cell", "at.away").drop("at")
            rows = written(rows, "knn-train-cells")
            count, reach = np.zeros(len(pivots), int), np.zeros(len(pivots))
            sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach"))
            for row in sizes.collect():  # one row per pivot
                count[row["cell"]], reach[row["cell"]] = row["n"], row["reach"]
            self._cells = rows, Cells(pivots, metric, count, reach, self.bundle_rows)
        return self._cells

    def _found(self, routed: DataFrame) -> DataFrame:
        """``k`` candidates of every bundle for ``routed(_q, x, bundle)``, block by block."""
        rows, cells = self._by_cell()
        spark, k, metric, size = routed.sparkSession, self.k, self.metric, self.bundle_rows
        asked = {r["bundle"]: r["count"] for r in routed.groupBy("bundle").count().collect()}  # at most one row per pivot
        # enough blocks of test rows for all tasks, but train rows are not sent much more often than test rows
        wanted = math.ceil(shuffle_partitions(spark) / max(1, len(asked)))
        cut = lambda n: max(math.ceil(n / max(size, self.most_rows)), min(wanted, math.ceil(2 * n / size)))
        blocks = [(b, cut(n), math.ceil(int(cells.load[b]) / size)) for b, n in asked.items()]
        self.sent["test"] += sum(asked[b] * train for b, _, train in blocks)
        self.sent["train"] += sum(int(cells.load[b]) * test for b, test, _ in blocks)
        table = spark.createDataFrame(blocks, "bundle int, test_blocks int, train_blocks int")
        member = spark.createDataFrame(list(enumerate(cells.bundle.tolist())), "cell int, bundle int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = routed.join(F.broadcast(table), "bundle").select(
            "_q", "x", "bundle", _block("_q", F.col("test_blocks")).alias("test_block"), every("train_blocks").alias("train_block")
        )
        # salted by the row: copies must not fill one block
        right = rows.join(F.broadcast(member.join(table, "bundle")), "cell").select(
            "train_id", "_row", "x", "bundle",
            _block("_row", F.col("train_blocks")).alias("train_block"), every("test_blocks").alias("test_block"),
        )

        def search(test_pdf: pd.DataFrame, train_pdf: pd.DataFrame) -> pd.DataFrame:
            if test_pdf.empty or train_pdf.empty:
                return pd.DataFrame({c: pd.Series(dtype=object) for c in ("_q", "_row", "train_id", "distance")})
            train_pdf = train_pdf.sort_values(["train_id", "_row"], kind="stable")
            found = list(top_k(_matrix(test_pdf["x"]), _matrix(train_pdf["x"]), k, metric))
            near = np.vstack([n for n, _ in found])
            return pd.DataFrame(
                {
                    "_q": np.repeat(test_pdf["_q"].to_numpy(), near.shape[1]),
                    "_row": train_pdf["_row"].to_numpy()[near.ravel()],
                    "train_id": train_pdf["train_id"].to_numpy()[near.ravel()],
                    "distance": np.vstack([d for _, d in found]).ravel(),
                }
            )

        keys = ["bundle", "test_block", "train_block"]
        grouped = left.groupBy(*keys).cogroup(right.groupBy(*keys))
        return grouped.applyInPandas(search, "_q bigint, _row bigint, train_id bigint, distance double")

    def _candidates(self, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Test rows with the number ``_q`` of their vector, and the k nearest of every number."""
        _, cells = self._by_cell()
        shared, k = test.sparkSession.sparkContext.broadcast(cells), self.k
        rows = test.withColumn("_x", F.col("x").cast("array<double>"))
        # copies of a vector share their neighbours; the number is written, hence the same in every pass
        asked = written(rows.groupBy("_x").agg(F.lit(1)).select("_x").withColumn("_q", F.monotonically_increasing_id()), "knn-asked")
        rows = written(rows.join(asked, "_x").drop("_x"), "knn-test")
        asked = asked.withColumnRenamed("_x", "x")

        @F.pandas_udf("array<int>")
        def first(x: pd.Series) -> pd.Series:
            parts = _in_slices(lambda some: shared.value.first(some, k), _matrix(x))
            return pd.Series([row for part in parts for row in part], dtype=object)

        @F.pandas_udf("array<int>")
        def other(x: pd.Series, bound: pd.Series) -> pd.Series:
            parts = _in_slices(lambda some, b: shared.value.other(some, k, b), _matrix(x), bound.to_numpy(float))
            return pd.Series([row for part in parts for row in part], dtype=object)

        order = Window.partitionBy("_q").orderBy("distance", "train_id", "_row")

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        routed = written(asked.select("_q", "x", F.explode(once(first)("x")).alias("bundle")), "knn-first")
        begun = written(best(self._found(routed)), "knn-begun")
        bounds = begun.where(F.col("rank") == k).select("_q", F.col("distance").alias("bound"))
        more = asked.join(bounds, "_q").select("_q", "x", F.explode(once(other)("x", "bound")).alias("bundle"))
        more = self._found(written(more, "knn-more"))
        return rows, written(best(begun.drop("rank").unionByName(more)), "knn-nearest")

    def _predict_blocks(self, test: DataFrame) -> DataFrame:
        rows, best = self._candidates(test)

        def mean(name: str, j: int):
            value = F.get(name, F.lit(j))
            return F.avg(F.when(~F.isnan(value), value))

        outcomes = self._by_cell()[0].select("_row", "perf", "cost")
        means = best.join(outcomes, "_row").groupBy("_q").agg(
            F.array(*[mean("perf", j) for j in range(self.models)]).alias("perf_pred"),
            F.array(*[mean("cost", j) for j in range(self.models)]).alias("cost_pred"),
        )
        return rows.join(means, "_q").drop("_q")
