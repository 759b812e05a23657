import math

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st

from pyspark.sql import functions as F

import naive
from tollgate.operators.frontier import Best, curve_metrics, pareto_frontier
from tollgate.operators.scan import previous, range_buckets, running
from tollgate.operators.sweep import budget_sweep, choice_under_budget, oracle_predictions, random_sweep

SCHEMA = (
    "item_id long, perf_pred array<double>, cost_pred array<double>, perf array<bigint>, cost array<bigint>"
)


def frame(spark, perf_pred, cost_pred, perf, cost, partitions=3):
    def cells(row):
        return [None if math.isnan(x) else float(x) for x in row]

    rows = [
        (i, cells(p), cells(c), [int(x) for x in tp], [int(x) for x in tc])
        for i, (p, c, tp, tc) in enumerate(zip(perf_pred, cost_pred, perf, cost))
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def curve(points):
    return sorted((r.threshold, r.cost, r.performance) for r in points.collect())


def same(got, expected):
    """Equal row by row, up to rounding."""
    assert len(got) == len(expected)
    assert np.array(got, float) == pytest.approx(np.array(expected, float))


def case(seed, n=60, m=4, levels=6):
    """Many ties in predicted cost and performance, and missing predictions."""
    rng = np.random.default_rng(seed)
    perf_pred = rng.integers(0, levels, (n, m)).astype(float)
    cost_pred = rng.integers(1, 4 * levels, (n, m)).astype(float)
    perf_pred[rng.random((n, m)) < 0.05] = np.nan
    cost_pred[rng.random((n, m)) < 0.05] = np.nan
    return perf_pred, cost_pred, rng.integers(0, 2, (n, m)), rng.integers(1, 1000, (n, m))


@pytest.mark.parametrize("fallback", ["first", "cheapest"])
@pytest.mark.parametrize("tie", ["index", "cheapest"])
@pytest.mark.parametrize("seed, n, m, buckets", [(1, 60, 4, 1), (2, 60, 4, 7), (3, 1, 5, 3), (4, 40, 1, 2)])
def test_sweep_against_every_budget(spark, seed, n, m, buckets, tie, fallback):
    data = case(seed, n, m)
    got = curve(budget_sweep(frame(spark, *data), tie=tie, fallback=fallback, buckets=buckets))
    same(got, naive.sweep(*data, fallback=fallback, tie=tie))


@settings(
    max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate]
)
@given(st.integers(0, 10**6), st.integers(1, 25), st.integers(1, 6), st.integers(1, 9))
def test_sweep_on_random_tables(spark, seed, n, m, buckets):
    data = case(seed, n, m, levels=3)
    got = curve(budget_sweep(frame(spark, *data), buckets=buckets))
    same(got, naive.sweep(*data))


def test_one_cost_shared_by_all(spark):
    perf_pred = np.tile([1.0, 2.0], (500, 1))
    cost_pred = np.tile([5.0, 5.0], (500, 1))
    perf, cost = np.tile([0, 1], (500, 1)), np.tile([3, 9], (500, 1))
    points = budget_sweep(frame(spark, perf_pred, cost_pred, perf, cost))
    assert curve(points) == [(5.0, 9.0, 1.0)]
    row = curve_metrics(pareto_frontier(points), Best(1.0, 9.0)).first()
    assert math.isnan(row.nauc) and row.ps == 1.0 and row.qnc == 1.0


def test_perfect_information_is_not_the_cheapest(spark):
    df = frame(spark, [[0, 0]], [[0, 0]], [[1, 1]], [[9, 2]])
    points = curve(budget_sweep(oracle_predictions(df)))
    # below 9 only the second is feasible; at 9 the tie goes to the first
    assert points == [(2.0, 2.0, 1.0), (9.0, 9.0, 1.0)]
    points = curve(budget_sweep(oracle_predictions(df), tie="cheapest"))
    assert points == [(2.0, 2.0, 1.0), (9.0, 2.0, 1.0)]


def test_perfect_information_dominates(spark):
    _, _, perf, cost = case(11)
    df = frame(spark, perf, cost, perf, cost)
    top = max(p for _, _, p in curve(budget_sweep(oracle_predictions(df), tie="cheapest")))
    assert top == pytest.approx(perf.max(axis=1).mean())


def test_choice_under_one_budget(spark):
    data = case(5)
    budget = 9.0
    got = {r.item_id: (r.perf, r.cost) for r in choice_under_budget(frame(spark, *data), budget).collect()}
    for i in range(60):
        options = [j for j in range(4) if data[1][i, j] <= budget]
        rank = lambda j: (-math.inf if math.isnan(data[0][i, j]) else -data[0][i, j], j)
        j = min(options, key=rank) if options else 0
        assert got[i] == (data[2][i, j], data[3][i, j])


def test_unknown_options_are_refused(spark):
    df = frame(spark, *case(1, 2, 2))
    with pytest.raises(ValueError):
        budget_sweep(df, tie="x")
    with pytest.raises(ValueError):
        budget_sweep(df, fallback="x")


def test_running_sums_and_maxima(spark):
    rng = np.random.default_rng(0)
    keys = rng.permutation(400)
    values = rng.integers(-50, 50, 400)
    rows = [(float(k), int(x)) for k, x in zip(keys, values)]
    df = spark.createDataFrame(rows, "k double, x long")
    order = sorted(rows)
    for buckets in (1, 5, 40):
        ranged = range_buckets(df, "k", "t", buckets)
        sums = {r.k: r.x for r in running(ranged, "k", sums=("x",)).collect()}
        assert [sums[k] for k, _ in order] == list(np.cumsum([x for _, x in order]))
        tops = {r.k: r.max_x for r in running(ranged, "k", maxima=("x",), before=True).collect()}
        best = np.maximum.accumulate([x for _, x in order])
        assert [tops[k] for k, _ in order] == [None, *best[:-1]]
        prev = {r.k: r.prev_k for r in previous(ranged, "k", ("k",)).collect()}
        assert [prev[k] for k, _ in order] == [None, *[k for k, _ in order[:-1]]]


@pytest.mark.parametrize("seed, buckets", [(0, 1), (1, 4), (2, 30)])
def test_frontier_and_metrics(spark, seed, buckets):
    rng = np.random.default_rng(seed)
    points = [(float(c), float(p / 16)) for c, p in zip(rng.integers(1, 90, 200), rng.integers(0, 17, 200))]
    df = spark.createDataFrame(points + [(None, 0.5), (1.0, None), (0.5, math.nan)], "cost double, performance double")
    front = pareto_frontier(df, buckets)
    rows = sorted((r.cost, r.performance, r.prev_cost, r.prev_performance) for r in front.collect())
    expected = naive.frontier(points)
    assert [r[:2] for r in rows] == expected
    assert [r[2:] for r in rows] == [(None, None), *expected[:-1]]
    accuracies, costs = [0.3, 0.9, 0.9], [4.0, 7.0, 5.0]
    row = curve_metrics(front, Best(0.9, 7.0)).first()
    assert (row.nauc, row.ps, row.qnc) == pytest.approx(
        naive.metrics(points, accuracies, costs), nan_ok=True
    )


def test_frontier_of_a_sweep_equals_that_of_its_points(spark):
    data = case(8, 80, 5)
    points = budget_sweep(frame(spark, *data), buckets=6)
    with_ranges = sorted((r.cost, r.performance) for r in pareto_frontier(points).collect())
    same(with_ranges, naive.frontier([(c, p) for _, c, p in naive.sweep(*data)]))
    without = sorted((r.cost, r.performance) for r in pareto_frontier(points.drop("bucket")).collect())
    assert with_ranges == without


def test_metrics_out_of_reach(spark):
    df = spark.createDataFrame([(1.0, 0.1), (3.0, 0.5)], "cost double, performance double")
    front = pareto_frontier(df)
    row = curve_metrics(front, Best(0.6, 2.0)).first()
    assert row.nauc == pytest.approx(0.3) and math.isinf(row.qnc)
    assert math.isinf(curve_metrics(front, Best(0.1, 0.0)).first().qnc)
    empty = curve_metrics(pareto_frontier(df.limit(0)), Best(0.1, 1.0)).first()
    assert math.isnan(empty.nauc) and math.isnan(empty.ps) and math.isinf(empty.qnc)


def test_random_sweep(spark):
    _, _, perf, cost = case(3, 300, 4)
    df = frame(spark, perf, cost, perf, cost)
    rows = random_sweep(df, 4, trials=20).collect()
    assert len(rows) == 20 and [r.cost for r in rows] == sorted(r.cost for r in rows)
    assert np.mean([r.performance for r in rows]) == pytest.approx(perf.mean(), abs=0.03)
    again = random_sweep(df.repartition(9), 4, trials=20).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
    assert random_sweep(df, 4, trials=20, seed=1).collect() != rows


def test_ranges_follow_the_rows(spark, monkeypatch):
    from tollgate.operators import scan

    monkeypatch.setattr(scan, "RANGE_ROWS", 10)
    df = spark.range(100).select(F.col("id").cast("double").alias("k"), F.lit(1).alias("v"))
    ranged = scan.range_buckets(df, "k", "ranges")
    assert ranged.select(scan.BUCKET).distinct().count() == 10
    total = scan.running(ranged, "k", sums=("v",))
    assert sorted(r.v for r in total.collect()) == list(range(1, 101))
