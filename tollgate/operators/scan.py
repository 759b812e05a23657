"""Running sums and maxima over a global order, without one global task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tollgate.session import shuffle_partitions, written

BUCKET = "bucket"

# Rows of a range, sorted by one task.
RANGE_ROWS = 2_000_000


def range_buckets(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in ``buckets`` consecutive ranges of ``key``.

    Their number follows the rows, so that a range stays a task's worth however many
    there are. The rows are written before they are counted: the sampling of the
    ranges then reads them instead of working them out again. The range number is
    stored with the row, so every later pass agrees on it. Equal keys share a range:
    callers aggregate by key first, which leaves no hot key to fill a range.
    """
    if buckets is None:
        df = written(df, f"{name}-rows")
        buckets = max(shuffle_partitions(df.sparkSession), math.ceil(df.count() / RANGE_ROWS))
    n = buckets
    ranged = df.repartitionByRange(n, key).withColumn(BUCKET, F.spark_partition_id())
    return written(ranged, name)


def running(
    ranged: DataFrame,
    key: str,
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    before: bool = False,
) -> DataFrame:
    """Replace ``sums`` by running sums and add ``max_<c>`` for ``maxima``.

    Totals per range (one row each) are carried over to the later ranges; inside
    a range an ordinary window does the rest. With ``before`` the row itself is
    left out, as in a frame that ends one row earlier.
    """
    carried = _carry(ranged, sums, maxima)
    within = (
        Window.partitionBy(BUCKET)
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    )
    summed = {
        c: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(f"carry_{c}", F.lit(0))
        for c in sums
    }
    return _with_carry(ranged, carried).select(
        *[summed[c].alias(c) if c in summed else F.col(c) for c in ranged.columns],
        *[
            F.greatest(F.max(c).over(within), F.col(f"carry_{c}")).alias(f"max_{c}")
            for c in maxima
        ],
    )


def previous(ranged: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<c>``: the value in the row before, across ranges.

    For columns that grow with the key, as on a frontier: the last value of all
    earlier ranges is then their maximum.
    """
    within = Window.partitionBy(BUCKET).orderBy(key)
    return _with_carry(ranged, _carry(ranged, (), columns)).select(
        *ranged.columns,
        *[
            F.coalesce(F.lag(c).over(within), F.col(f"carry_{c}")).alias(f"prev_{c}")
            for c in columns
        ],
    )


def _carry(ranged: DataFrame, sums: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    """Sums and maxima over all earlier ranges, one row per range."""
    totals = ranged.groupBy(BUCKET).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima]
    )
    # one row per range: a window over all of them is as small as their number
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        F.col(BUCKET).alias("carry_bucket"),
        *[F.sum(c).over(earlier).alias(f"carry_{c}") for c in sums],
        *[F.max(c).over(earlier).alias(f"carry_{c}") for c in maxima],
    )


def _with_carry(ranged: DataFrame, carried: DataFrame) -> DataFrame:
    return ranged.join(F.broadcast(carried), F.col(BUCKET) == F.col("carry_bucket"), "left")
