"""Near duplicates among vectors of one label by PCA-ordered tiled comparison.

Copies of a vector are one class. Unit vectors are rotated to the principal axes of a
sample, ordered into cells of the leading axes, and dealt into tiles of bounded size.
Tiles meet when their boxes are near enough. Within a pair of tiles products are added
up axis by axis, leading axes first: what the rest can still add is at most the product
of the suffix norms, and pairs stop as soon as the threshold is out of reach. Pairs that
remain are decided by the cosine of the given vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tollgate.llm.common import components, forest
from tollgate.session import small_side, written

# Vectors the axes are fitted on; any orthonormal axes give the same links.
SAMPLE_ROWS = 20_000
TILE_ROWS = 2_048
# Axes added up between two looks at the bound.
AXES = 16
# Axes of which boxes are kept, and at most as many as make cells.
BOX_AXES = 8
# Rounding that a bound may be off by; only makes pairs stay longer.
SLACK = 1e-9


def finite(vector: str) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled by their largest component first, against overflow."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), "f8").reshape(-1, width)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by number of components, from a bounded sample taken by a hash of the vector."""
    total = vectors.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    place = F.pmod(F.xxhash64("vector", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = vectors.where(place < share).select("width", "vector").collect()
    by_width: dict[int, list] = {}
    for row in rows:
        by_width.setdefault(row["width"], []).append(row["vector"])
    axes = {}
    for width, some in by_width.items():
        points = unit(np.asarray(some, "f8"))
        points = points - points.mean(axis=0)
        _, found = np.linalg.eigh(points.T @ points)
        axes[width] = found[:, ::-1]
    return axes


def rotated(matrix: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit rows on the principal axes, or as they are where the sample had none so wide."""
    points = unit(matrix)
    found = axes.get(matrix.shape[1])
    return points if found is None else points @ found


def near_pairs(a: np.ndarray, b: np.ndarray, least: float, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose product can reach ``least``, leading axes first."""
    width = a.shape[1]
    cuts = [*range(0, width, AXES), width]
    rest_a = np.sqrt(np.maximum((a[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum((b[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1], 0))
    out_x, out_y = [], []
    for first in range(0, len(a), 256):
        rows = a[first : first + 256]
        sums, head = rows[:, : cuts[1]] @ b[:, : cuts[1]].T, cuts[1]
        bound = sums if head == width else sums + np.outer(rest_a[first : first + 256, head], rest_b[:, head])
        x, y = np.nonzero(bound >= least - SLACK)
        if itself:
            x, y = x[x + first < y], y[x + first < y]
        value = sums[x, y]
        for start, stop in zip(cuts[1:-1], cuts[2:]):
            if not len(x):
                break
            value = value + np.einsum("ij,ij->i", rows[x, start:stop], b[y, start:stop])
            if stop < width:
                open_ = value + rest_a[first + x, stop] * rest_b[y, stop] >= least - SLACK
                x, y, value = x[open_], y[open_], value[open_]
        done = value >= least - SLACK
        out_x.append(x[done] + first)
        out_y.append(y[done])
    return np.concatenate(out_x), np.concatenate(out_y)


def _compare(axes, least: float):
    """Task function on a pair of tiles: links per class and joining edges."""

    def over(pair: pa.Table) -> pa.Table:
        side = np.asarray(pair.column("side"))
        width = pair.column("width")[0].as_py()
        raw = matrix_of(pair.column("vector"), width)
        names, weight = np.asarray(pair.column("class")), np.asarray(pair.column("n"))
        points = rotated(raw, axes.value)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        itself = not len(right)
        right = left if itself else right
        x, y = near_pairs(points[left], points[right], least, itself)
        x, y = left[x], right[y]
        exact = np.zeros(len(x), bool)
        scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # else squares of large or small components overflow
        norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        for i in range(0, len(x), 65_536):
            p, q = x[i : i + 65_536], y[i : i + 65_536]
            exact[i : i + 65_536] = np.einsum("ij,ij->i", scaled[p], scaled[q]) / (norms[p] * norms[q]) >= least
        x, y = x[exact], y[exact]
        links = np.bincount(x, weight[y], len(names)) + np.bincount(y, weight[x], len(names))
        some = np.flatnonzero(links)
        root = forest(x, y, len(names))
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([names[some], names[joined]]), pa.int64()),
                "b": pa.array([*[None] * len(some), *names[root[joined]].tolist()], pa.int64()),
                "links": pa.array([*links[some].astype("i8").tolist(), *[None] * len(joined)], pa.int64()),
            }
        )

    return over


def _tiles(classes: DataFrame, axes, reach: float) -> tuple[DataFrame, DataFrame]:
    """Classes with their tile, and the tiles with their boxes on the leading axes."""
    shared = axes

    @F.pandas_udf("array<double>")
    def leading(vectors):
        import pandas as pd

        widths, out = np.fromiter(map(len, vectors), int, len(vectors)), np.empty(len(vectors), object)
        for width in np.unique(widths):  # rows of one width are multiplied at once
            at = np.flatnonzero(widths == width)
            turned = rotated(np.array(vectors.iloc[at].tolist(), "f8"), shared.value)[:, :BOX_AXES]
            for i, row in zip(at, turned):
                out[i] = row
        return pd.Series(out)

    groups = classes.groupBy("label", "width").agg(F.count("*").alias("rows"))
    total = classes.count()
    # as many leading axes make cells as leave a tile's worth of vectors in a cell
    depth = F.greatest(F.lit(1), F.least(F.lit(BOX_AXES), F.floor(F.log2(F.col("rows") / TILE_ROWS) / 2)))
    groups = groups.select("label", "width", F.coalesce(depth, F.lit(1)).cast("int").alias("depth"))
    placed = classes.withColumn("lead", leading.asNondeterministic()("vector"))
    placed = placed.join(small_side(groups, total, 24), ["label", "width"])
    placed = placed.withColumn("cell", F.transform(F.slice("lead", F.lit(1), F.col("depth")), lambda x: F.floor(x / reach)))
    placed = written(placed, "cells")
    counts = placed.groupBy("label", "width", "cell").agg(F.count("*").alias("together"))
    placed = placed.join(small_side(counts, total, 24 + 8 * BOX_AXES), ["label", "width", "cell"])
    salt = F.pmod(F.xxhash64("class", F.lit(3)), F.ceil(F.col("together") / TILE_ROWS))
    placed = written(
        placed.withColumn("tile", F.xxhash64("label", "width", "cell", salt)).select(
            "label", "width", "tile", F.element_at("cell", 1).alias("slot"), "lead", "class", "n", "vector"
        ), "tiles")
    at = [F.coalesce(F.get("lead", F.lit(i)), F.lit(0.0)) for i in range(BOX_AXES)]
    boxes = placed.groupBy("label", "width", "slot", "tile").agg(
        F.array(*[F.min(c) for c in at]).alias("low"), F.array(*[F.max(c) for c in at]).alias("high")
    )
    return placed, written(boxes, "boxes")


def _tile_pairs(boxes: DataFrame, reach: float) -> DataFrame:
    """Pairs of tiles whose boxes are within reach: equal slots or neighbours on the first axis."""
    near = boxes.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1)))
    x, y = boxes.alias("x"), near.alias("y")
    gaps = [
        F.greatest(F.lit(0.0), F.col("x.low")[i] - F.col("y.high")[i], F.col("y.low")[i] - F.col("x.high")[i])
        for i in range(BOX_AXES)
    ]
    apart = sum((g * g for g in gaps), F.lit(0.0))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "width", "slot")]
    pairs = x.join(y, same[0] & same[1] & same[2] & (apart <= reach * reach + SLACK))
    pairs = pairs.select(F.least("x.tile", "y.tile").alias("left"), F.greatest("x.tile", "y.tile").alias("right"))
    pairs = written(pairs.distinct().withColumn("pair", F.xxhash64("left", "right")), "tile_pairs")
    return pairs.select("pair", F.col("left").alias("tile"), F.lit(0).alias("side")).unionByName(
        pairs.where("left <> right").select("pair", F.col("right").alias("tile"), F.lit(1).alias("side"))
    )


def cosine_links(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Links by cosine of at least ``least`` within a label, one row per row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``. Returns ``vec_id``,
    ``n_links`` (other rows linked directly), ``component_id`` (the least ``vec_id``
    reachable, the row itself included) and ``kept`` (``vec_id`` is that least one).
    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do rows without a label; vectors of different length never link. Rows
    that repeat each other count as other rows. No rows give no rows.
    """
    spark = vectors.sparkSession
    whole = finite("embedding") & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long"), "label",
        F.when(whole & F.col("label").isNotNull(), F.transform("embedding", lambda x: x.cast("double"))).alias("vector"),
    )
    rows = rows.withColumn("class", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    classes = rows.where("vector is not null").groupBy("label", "class", "vector").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least_id")
    )
    classes = written(classes.withColumn("width", F.size("vector")), "vector_classes")
    axes = spark.sparkContext.broadcast(principal_axes(classes))
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    placed, boxes = _tiles(classes, axes, reach)
    sides = _tile_pairs(boxes, reach)
    work = placed.select("tile", "width", "class", "n", "vector").join(
        small_side(sides, sides.count(), 32), "tile"
    )
    found = written(
        work.groupBy("pair").applyInArrow(_compare(axes, least), "a long, b long, links long"), "vector_links"
    )
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"), "vector_components")
    named = classes.select("class", "n", "least_id").join(joined, F.col("class") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "class")).drop("node")
    least_of = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = named.join(least_of, "root").join(counts, F.col("class") == F.col("a"), "left")
    of = written(of.select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "of")
    out = rows.select("vec_id", "class").join(of, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
