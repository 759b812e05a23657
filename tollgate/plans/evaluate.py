"""Fit, sweep and summarise routing policies."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tollgate.operators import fusion
from tollgate.operators.frontier import (
    Best,
    best_single_model,
    curve_metrics,
    pareto_frontier,
    single_models,
)
from tollgate.operators.outcomes import Outcomes
from tollgate.operators.sweep import budget_sweep, oracle_predictions, random_sweep
from tollgate.routers import (
    ClusterPolicy,
    CrossModalPolicy,
    LinearPolicy,
    LowRankPolicy,
    NearestPolicy,
    NetFactorPolicy,
    NetPolicy,
)

Features = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Scales:
    """Units per 1.0 of performance and cost while sums are formed."""

    perf: float = 1
    cost: float = 1


@dataclass(frozen=True)
class Evaluation:
    """Results of one policy; the curve and its frontier stay distributed."""

    points: DataFrame
    frontier: DataFrame
    baselines: DataFrame
    metrics: DataFrame


def average(df: DataFrame, flag: str) -> DataFrame:
    return fusion.average_features(df, flag)


def adaptive(df: DataFrame, flag: str) -> DataFrame:
    return fusion.adaptive_features(df, flag)


def crossed(df: DataFrame, flag: str) -> DataFrame:
    return fusion.cross_features(df, flag)


# policy name -> (policy, features it takes)
LEARNED: Mapping[str, tuple[Callable, Features]] = {
    "kmeans": (ClusterPolicy, average),
    "kmeansnew": (ClusterPolicy, adaptive),
    "knn": (NearestPolicy, average),
    "linear": (LinearPolicy, average),
    "linearmf": (LowRankPolicy, average),
    "mlp": (NetPolicy, average),
    "mlpmf": (NetFactorPolicy, average),
    "cmr": (CrossModalPolicy, crossed),
}


def predictions(
    name: str, items: DataFrame, is_train: Column, mode: str = "22", policy=None
) -> DataFrame:
    """Test items with the predictions of the named policy.

    ``items`` carries ``text_emb``, ``img_emb``, ``perf`` and ``cost``. The first
    digit of ``mode`` names the train modality, the second that of the test.
    """
    if name == "oracle":
        return oracle_predictions(items.where(~is_train))
    make, features = LEARNED[name]
    fitted = (policy or make()).fit(features(items.where(is_train), mode[0]))
    return fitted.predict(features(items.where(~is_train), mode[1]))


def curve(
    name: str, outcomes: Outcomes, is_train: Column, scales: Scales, mode: str = "22", policy=None
) -> DataFrame:
    """Points ``(cost, performance)`` of the named policy on the test items."""
    if name == "random":
        return random_sweep(
            outcomes.items.where(~is_train),
            len(outcomes.models),
            perf_scale=scales.perf,
            cost_scale=scales.cost,
        )
    predicted = predictions(name, outcomes.items, is_train, mode, policy)
    return budget_sweep(predicted, scales.perf, scales.cost)


def best_of(baselines: DataFrame) -> Best:
    row = best_single_model(baselines).first()
    return Best(row["accuracy"], row["avg_cost"])


def evaluate(
    name: str,
    outcomes: Outcomes,
    is_train: Column,
    scales: Scales = Scales(),
    mode: str = "22",
    policy=None,
) -> Evaluation:
    """Fit on the train items, sweep the budget over the test items, summarise."""
    points = curve(name, outcomes, is_train, scales, mode, policy)
    test = outcomes.with_items(outcomes.items.where(~is_train))
    baselines = single_models(test, scales.perf, scales.cost)
    frontier = pareto_frontier(points)
    return Evaluation(points, frontier, baselines, curve_metrics(frontier, best_of(baselines)))


def summary(evaluation: Evaluation, router: str, dataset: str, mode: str) -> DataFrame:
    """One row: run, metrics and the single-model baselines in model order.

    The frontier is no part of the row, but its size is: it may hold as many points as
    there are distinct costs, and is a table of its own (``sinks.save_run``).
    """
    baselines = sorted(evaluation.baselines.collect(), key=lambda r: r["model_idx"])
    single = F.array(
        *[F.struct(*[F.lit(value).alias(key) for key, value in r.asDict().items()]) for r in baselines]
    )
    return evaluation.metrics.select(
        F.lit(router).alias("router"),
        F.lit(dataset).alias("dataset"),
        F.lit(mode).alias("mode"),
        F.struct("nauc", "ps", "qnc").alias("metrics"),
        single.alias("single_model"),
        F.col("points").alias("frontier_points"),
    )


def compare(
    names, outcomes: Outcomes, is_train: Column, scales: Scales = Scales(), mode: str = "22", policies=None
) -> DataFrame:
    """Metrics of several policies on the same split, one row each."""
    policies = policies or {}
    test = outcomes.with_items(outcomes.items.where(~is_train))
    best = best_of(single_models(test, scales.perf, scales.cost))
    rows = []
    for name in names:
        points = curve(name, outcomes, is_train, scales, mode, policies.get(name))
        metrics = curve_metrics(pareto_frontier(points), best)
        rows.append(metrics.select(F.lit(name).alias("router"), "nauc", "ps", "qnc", "points"))
    return reduce(DataFrame.unionByName, rows)
