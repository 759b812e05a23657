"""Budget sweeps: the cost-performance curve of a routing policy.

For a budget C every item takes, among the models predicted to cost at most C,
the one predicted to perform best; the curve holds the mean true cost and
performance for every distinct predicted cost. As C grows an item changes its
choice only at its own predicted costs, so the curve is a running sum over at
most (items x models) changes and never an item-by-budget join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tollgate.functions.draws import draw_below
from tollgate.operators.scan import BUCKET, range_buckets, running


def _options() -> Column:
    """Predicted and true values per model; models of unknown cost drop out."""
    zipped = F.arrays_zip("cost_pred", "perf_pred", "perf", "cost")
    options = F.transform(
        zipped,
        lambda o, j: F.struct(
            o["cost_pred"].alias("cost_pred"),
            j.alias("model_idx"),
            # a missing prediction ranks highest, as an argmax over NaN does
            F.coalesce(o["perf_pred"].cast("double"), F.lit(float("nan"))).alias("perf_pred"),
            o["perf"].alias("perf"),
            o["cost"].alias("cost"),
        ),
    )
    return F.filter(
        options, lambda o: o["cost_pred"].isNotNull() & ~F.isnan(o["cost_pred"].cast("double"))
    )


def _ranked(option: Column, tie: str) -> Column:
    """Struct whose maximum is the option to choose."""
    index = (-option["model_idx"]).alias("tie_idx")
    if tie == "index":
        keys = [option["perf_pred"].alias("perf_pred"), index]
    elif tie == "cheapest":
        keys = [
            option["perf_pred"].alias("perf_pred"),
            (-option["cost_pred"]).alias("tie_cost"),
            index,
        ]
    else:
        raise ValueError(f"tie must be 'index' or 'cheapest', not {tie!r}")
    return F.struct(*keys, option["perf"].alias("perf"), option["cost"].alias("cost"))


def choice_under_budget(
    predictions: DataFrame, budget: float, tie: str = "index", fallback: str = "first"
) -> DataFrame:
    """Chosen model with its true values for one budget, one row per item."""
    feasible = F.filter(_options(), lambda o: o["cost_pred"] <= F.lit(budget))
    best = F.array_max(F.transform(feasible, lambda o: _ranked(o, tie)))
    start = _start(_options(), fallback)
    rest = [c for c in predictions.columns if c not in ("perf_pred", "cost_pred", "perf", "cost")]
    return predictions.select(*rest, best.alias("best"), start.alias("start")).select(
        *rest,
        F.coalesce(-F.col("best.tie_idx"), F.col("start.model_idx")).alias("model_idx"),
        F.coalesce(F.col("best.perf"), F.col("start.perf")).alias("perf"),
        F.coalesce(F.col("best.cost"), F.col("start.cost")).alias("cost"),
        F.col("best").isNotNull().alias("feasible"),
    )


def _start(options: Column, fallback: str) -> Column:
    """What an item takes below its cheapest option."""
    first = F.struct(
        F.lit(0).alias("model_idx"),
        F.get("perf", F.lit(0)).alias("perf"),
        F.get("cost", F.lit(0)).alias("cost"),
    )
    if fallback == "first":
        return first
    if fallback != "cheapest":
        raise ValueError(f"fallback must be 'first' or 'cheapest', not {fallback!r}")
    low = F.array_min(options)
    cheapest = F.struct(
        low["model_idx"].alias("model_idx"), low["perf"].alias("perf"), low["cost"].alias("cost")
    )
    return F.when(F.size(options) > 0, cheapest).otherwise(first)


def choice_changes(
    predictions: DataFrame, tie: str = "index", fallback: str = "first"
) -> DataFrame:
    """Per threshold: the change of the summed true values when it is reached.

    The row at -infinity holds the item count and the sums below all thresholds.
    """
    ordered = predictions.select(
        F.array_sort(_options()).alias("options"),
        F.col("perf"),
        F.col("cost"),
    ).select(
        "options",
        F.transform("options", lambda o: _ranked(o, tie)).alias("ranked"),
        _start(F.col("options"), fallback).alias("start"),
    )
    chosen = ordered.select(
        "options",
        "start",
        F.transform(
            "ranked", lambda r, i: F.array_max(F.slice("ranked", F.lit(1), i + 1))
        ).alias("chosen"),
    )

    def change(option: Column, i: Column) -> Column:
        now = F.get("chosen", i)
        earlier = F.get("chosen", i - 1)
        return F.struct(
            option["cost_pred"].cast("double").alias("threshold"),
            F.lit(0).cast("bigint").alias("n"),
            (now["perf"] - F.when(i == 0, F.col("start.perf")).otherwise(earlier["perf"])).alias(
                "perf_sum"
            ),
            (now["cost"] - F.when(i == 0, F.col("start.cost")).otherwise(earlier["cost"])).alias(
                "cost_sum"
            ),
        )

    base = F.struct(
        F.lit(float("-inf")).alias("threshold"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("start.perf").alias("perf_sum"),
        F.col("start.cost").alias("cost_sum"),
    )
    # an item without predictions keeps its base event: it takes model 0 at every budget
    nothing = F.slice(F.array(base), F.lit(1), F.lit(0))
    changes = F.concat(F.array(base), F.coalesce(F.transform("options", change), nothing))
    return (
        chosen.select(F.inline(changes))
        .groupBy("threshold")
        .agg(F.sum("n").alias("n"), F.sum("perf_sum").alias("perf_sum"), F.sum("cost_sum").alias("cost_sum"))
    )


def budget_sweep(
    predictions: DataFrame,
    perf_scale: float = 1,
    cost_scale: float = 1,
    tie: str = "index",
    fallback: str = "first",
    buckets: int | None = None,
) -> DataFrame:
    """Curve points, one per distinct predicted cost.

    ``predictions`` has one row per item with the arrays ``perf_pred``,
    ``cost_pred`` and the true ``perf``, ``cost`` in model order. With true
    values in whole units (``in_units``) the sums are exact, and the scales turn
    the means back. ``bucket`` numbers the range of thresholds a point lies in.
    """
    changes = choice_changes(predictions, tie, fallback)
    ranged = range_buckets(changes, "threshold", "sweep", buckets)
    points = running(ranged, "threshold", sums=("n", "perf_sum", "cost_sum"))
    return points.where(F.col("threshold") > F.lit(float("-inf"))).select(
        BUCKET,
        (F.col("threshold") / F.lit(float(cost_scale))).alias("threshold"),
        "n",
        "perf_sum",
        "cost_sum",
        _mean("cost_sum", F.col("n"), cost_scale).alias("cost"),
        _mean("perf_sum", F.col("n"), perf_scale).alias("performance"),
    )


def _mean(total: str, n: Column, scale: float) -> Column:
    # in double: the product of a large count and a large scale exceeds 64 bits
    return F.col(total) / (n.cast("double") * F.lit(float(scale)))


def oracle_predictions(items: DataFrame) -> DataFrame:
    """Predictions of the policy with perfect information."""
    return items.withColumns({"perf_pred": F.col("perf"), "cost_pred": F.col("cost")})


def random_sweep(
    items: DataFrame,
    models: int,
    trials: int = 50,
    seed: int = 42,
    perf_scale: float = 1,
    cost_scale: float = 1,
) -> DataFrame:
    """One point per trial; in each, every item takes a uniformly drawn model.

    Missing outcomes are left out of the means. The trials of an item are laid
    out in its own task and summed before the shuffle.
    """
    picked = items.select(
        "item_id", "perf", "cost", F.explode(F.sequence(F.lit(0), F.lit(max(1, trials) - 1))).alias("trial")
    ).withColumn("pick", draw_below(models, seed, F.col("trial"), F.col("item_id")))
    return (
        picked.select(
            "trial",
            F.get("perf", F.col("pick")).alias("perf"),
            F.get("cost", F.col("pick")).alias("cost"),
        )
        .groupBy("trial")
        .agg(
            F.sum("cost").alias("cost_sum"), F.count("cost").alias("cost_n"),
            F.sum("perf").alias("perf_sum"), F.count("perf").alias("perf_n"),
        )
        .select(
            "trial",
            _mean("cost_sum", F.col("cost_n"), cost_scale).alias("cost"),
            _mean("perf_sum", F.col("perf_n"), perf_scale).alias("performance"),
        )
        .orderBy("cost")
    )
