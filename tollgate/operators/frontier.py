"""Pareto frontier of a curve and the metrics read off it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tollgate.operators.outcomes import Outcomes
from tollgate.operators.scan import BUCKET, previous, range_buckets, running


def pareto_frontier(points: DataFrame, buckets: int | None = None) -> DataFrame:
    """Points that beat every cheaper one, with the frontier point before each.

    Points without cost or performance are dropped. Of points of equal cost only
    the best can stay, so they are reduced to it first; that also spreads a cost
    shared by very many points. The points of a sweep come in ranges: those that
    are beaten within their range go before anything is shuffled.
    """
    known = points.where(
        F.col("cost").isNotNull()
        & F.col("performance").isNotNull()
        & ~F.isnan("cost")
        & ~F.isnan("performance")
    )
    if BUCKET in points.columns:
        cheaper = (
            Window.partitionBy(BUCKET)
            .orderBy("cost", F.desc("performance"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        known = _unbeaten(known.withColumn("max_performance", F.max("performance").over(cheaper)))
    best = known.groupBy("cost").agg(F.max("performance").alias("performance"))
    ranged = range_buckets(best, "cost", "frontier", buckets)
    kept = _unbeaten(running(ranged, "cost", maxima=("performance",), before=True))
    return previous(kept, "cost", ("cost", "performance")).drop(BUCKET)


def _unbeaten(scanned: DataFrame) -> DataFrame:
    top = F.col("max_performance")
    return scanned.where(top.isNull() | (F.col("performance") > top)).drop("max_performance")


def single_models(outcomes: Outcomes, perf_scale: float = 1, cost_scale: float = 1) -> DataFrame:
    """Mean accuracy and mean cost of always taking one model."""
    m = len(outcomes.models)

    def mean(name: str, j: int, scale: int):
        value = F.get(name, F.lit(j))
        return F.sum(value) / (F.count(value) * F.lit(scale))

    row = outcomes.items.agg(
        F.array(
            *[
                F.struct(
                    F.lit(j).alias("model_idx"),
                    F.lit(outcomes.models[j]).alias("model"),
                    mean("perf", j, perf_scale).alias("accuracy"),
                    mean("cost", j, cost_scale).alias("avg_cost"),
                )
                for j in range(m)
            ]
        ).alias("baselines")
    )
    return row.select(F.inline("baselines"))


def best_single_model(baselines: DataFrame) -> DataFrame:
    """The most accurate model, the first of them on a tie."""
    best = F.max(
        F.struct(
            F.col("accuracy"), (-F.col("model_idx")).alias("tie_idx"), F.col("model"), F.col("avg_cost")
        )
    )
    return baselines.agg(best.alias("best")).select(
        (-F.col("best.tie_idx")).alias("model_idx"),
        F.col("best.model").alias("model"),
        F.col("best.accuracy").alias("accuracy"),
        F.col("best.avg_cost").alias("avg_cost"),
    )


def curve_area(frontier: DataFrame) -> DataFrame:
    """Area under the frontier by trapezoids; NaN for fewer than two points."""
    return frontier.agg(
        F.count(F.lit(1)).alias("points"),
        F.min("cost").alias("min_cost"),
        F.max("cost").alias("max_cost"),
        F.max("performance").alias("peak"),
        F.coalesce(F.sum(_trapezoid()), F.lit(float("nan"))).alias("area"),
    )


def _trapezoid():
    width = F.col("cost") - F.col("prev_cost")
    return width * (F.col("performance") + F.col("prev_performance")) / 2


@dataclass(frozen=True)
class Best:
    """Accuracy and mean cost of the best single model."""

    accuracy: float
    cost: float


def curve_metrics(frontier: DataFrame, best: Best) -> DataFrame:
    """One row: normalised area ``nauc``, peak ``ps`` and the cost ``qnc`` at
    which the frontier reaches the best single model, relative to its cost."""
    reached = F.min(F.when(F.col("performance") >= F.lit(best.accuracy), F.col("cost")))
    row = frontier.agg(
        F.count(F.lit(1)).alias("points"),
        F.min("cost").alias("min_cost"),
        F.max("cost").alias("max_cost"),
        F.max("performance").alias("peak"),
        F.sum(_trapezoid()).alias("area"),
        reached.alias("reached"),
    )
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    span = F.col("max_cost") - F.col("min_cost")
    qnc = F.coalesce(F.col("reached") / F.lit(best.cost), inf) if best.cost > 0 else inf
    return row.select(
        F.coalesce(F.when(span > 0, F.col("area") / F.when(span > 0, span)), nan).alias("nauc"),
        F.coalesce(F.col("peak"), nan).alias("ps"),
        qnc.alias("qnc"),
        "points",
    )
