"""Outcome tables: one row per item, outcomes as arrays in model order.

``perf[j]`` and ``cost[j]`` belong to ``models[j]``; a missing outcome is NULL.
The array form keeps all that a routing decision needs in one row, so the
sweeps need no join and no shuffle per item.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Numeric cells read as missing.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ITEM_COLUMNS = ("item_id", "dataset", "question", "answer", "img_path")


@dataclass(frozen=True)
class Outcomes:
    items: DataFrame
    models: tuple[str, ...]

    def with_items(self, items: DataFrame) -> Outcomes:
        return Outcomes(items, self.models)

    def long(self) -> DataFrame:
        """One row per item and model.

        The outer form of the generator keeps the optimiser from adding a filter
        that would work the arrays out a second time; they are never empty.
        """
        names = F.array(*[F.lit(m) for m in self.models])
        rest = [c for c in self.items.columns if c not in ("perf", "cost")]
        return self.items.select(
            *rest, F.posexplode_outer(F.arrays_zip("perf", "cost")).alias("model_idx", "outcome")
        ).select(
            *rest,
            "model_idx",
            F.get(names, F.col("model_idx")).alias("model"),
            F.col("outcome.perf").alias("is_correct"),
            F.col("outcome.cost").alias("cost"),
        )


def infer_models(columns: Iterable[str]) -> tuple[str, ...]:
    """Sorted names with both a ``<model>_correct`` and a ``<model>_cost`` column."""
    columns = list(columns)
    correct = {c.removesuffix("_correct") for c in columns if c.endswith("_correct")}
    cost = {c.removesuffix("_cost") for c in columns if c.endswith("_cost")}
    return tuple(sorted(correct & cost))


def check_columns(columns: Iterable[str], required: Sequence[str] = ("question",)) -> tuple[str, ...]:
    """Model names of a wide table; ``ValueError`` before any job if it is unusable."""
    columns = list(columns)
    models = infer_models(columns)
    if not models:
        raise ValueError("no pair of <model>_correct and <model>_cost columns found")
    for name in required:
        if name not in columns:
            raise ValueError(f"the outcome table needs a {name!r} column")
    return models


def number(c: Column) -> Column:
    """Cell as double; missing marks and NaN become NULL, any other text is an error."""
    text = F.trim(c.cast("string"))
    value = F.when(~text.isin(*MISSING_CELLS), text.try_cast("double"))
    unreadable = text.isNotNull() & ~text.isin(*MISSING_CELLS) & text.try_cast("double").isNull()
    refused = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
    return F.when(unreadable, refused).when(~F.isnan(value), value)


def from_wide(wide: DataFrame, item_id: Column | None = None) -> Outcomes:
    """Normalise a wide table (``<model>_correct``, ``<model>_cost`` per model).

    The id defaults to a hash of all cells of a row, so it is the same on every
    read; exact copies of a row share it.
    """
    models = check_columns(wide.columns)

    def cell(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    def text(name: str) -> Column:
        return F.coalesce(cell(name).cast("string"), F.lit("")) if name in wide.columns else F.lit("")

    if item_id is None:
        item_id = F.xxhash64(*[cell(c).cast("string") for c in sorted(wide.columns)])
    items = wide.select(
        item_id.alias("item_id"),
        text("dataset").alias("dataset"),
        text("question").alias("question"),
        text("answer").alias("answer"),
        text("img_path").alias("img_path"),
        F.array(*[number(cell(f"{m}_correct")) for m in models]).alias("perf"),
        F.array(*[number(cell(f"{m}_cost")) for m in models]).alias("cost"),
    )
    return Outcomes(items, models)


def from_long(long: DataFrame, models: Sequence[str], keep: Sequence[str] = ("dataset",)) -> Outcomes:
    """Gather ``(item_id, model, is_correct, cost)`` rows per item.

    One shuffle on the item; the conditional maxima are combined before it, and
    absent (item, model) pairs come out as NULL. A row of a model that is not among
    ``models`` is an error, never left out.
    """
    models = tuple(models)
    strange = ~F.coalesce(F.col("model").isin(*models), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce("model", F.lit("NULL")))).cast("double")

    def per_model(value: str) -> Column:
        own = [F.max(F.when(F.col("model") == m, F.col(value).cast("double"))) for m in models[1:]]
        known = F.when(strange, refused).when(F.col("model") == models[0], F.col(value).cast("double"))
        return F.array(F.max(known), *own).alias("perf" if value == "is_correct" else "cost")

    items = long.groupBy("item_id", *keep).agg(per_model("is_correct"), per_model("cost"))
    return Outcomes(items, models)


def model_means(outcomes: Outcomes, where: Column | None = None) -> tuple[list[float], list[float]]:
    """Mean performance and mean cost per model, missing values left out.

    One aggregate job; one row of 2 x models numbers reaches the driver.
    """
    items = outcomes.items if where is None else outcomes.items.where(where)
    m = len(outcomes.models)
    row = items.agg(
        *[F.avg(F.get("perf", F.lit(j))) for j in range(m)],
        *[F.avg(F.get("cost", F.lit(j))) for j in range(m)],
    ).first()
    return list(row[:m]), list(row[m:])


def impute_means(outcomes: Outcomes, where: Column | None = None) -> Outcomes:
    """Replace missing outcomes by the mean of their model.

    The means are taken over all rows, or over those ``where`` selects (train
    only, say). A model without any value is refused: it cannot be routed to.
    """
    perf, cost = model_means(outcomes, where)
    empty = [m for m, p, c in zip(outcomes.models, perf, cost) if p is None or c is None]
    if empty:
        raise ValueError(f"models without any outcome or cost: {', '.join(empty)}")

    def filled(name: str, means: list[float]) -> Column:
        fill = F.array(*[F.lit(float(x)) for x in means])
        return F.zip_with(name, fill, lambda v, mean: F.coalesce(v, mean))

    items = outcomes.items.withColumns({"perf": filled("perf", perf), "cost": filled("cost", cost)})
    return outcomes.with_items(items)


def zero_missing(outcomes: Outcomes) -> Outcomes:
    """Replace missing outcomes by zero (targets of the linear policies)."""

    def filled(name: str) -> Column:
        return F.transform(name, lambda v: F.coalesce(v, F.lit(0.0)))

    return outcomes.with_items(
        outcomes.items.withColumns({"perf": filled("perf"), "cost": filled("cost")})
    )


def in_units(outcomes: Outcomes, perf_scale: float, cost_scale: float) -> Outcomes:
    """Outcomes as whole units (``round(value * scale)``).

    Sums of whole numbers do not depend on their order, so curves, ties on the
    frontier and comparisons with a baseline come out the same on every run.
    """

    def units(name: str, scale: float) -> Column:
        return F.transform(name, lambda v: F.round(v * F.lit(float(scale))).cast("bigint"))

    items = outcomes.items.withColumns(
        {"perf": units("perf", perf_scale), "cost": units("cost", cost_scale)}
    )
    return outcomes.with_items(items)


# Units that the smallest outcome must have, so that rounding to units keeps it apart from others.
LEAST_UNITS = 1_000


def fitting_scales(outcomes: Outcomes) -> tuple[float, float]:
    """The finest powers of ten in whose units all sums of performances and costs fit 64 bits.

    Sums over the items, and of their changes from model to model, stay below
    items x models x the largest value. Values that are too far apart for that (the smallest
    would have fewer than ``LEAST_UNITS``) are refused, not rounded away.
    """

    def bounds(name: str) -> list[Column]:
        sizes = F.transform(name, lambda v: F.abs(v.cast("double")))
        # an empty array has neither
        return [F.max(F.array_max(sizes)), F.min(F.array_min(F.filter(sizes, lambda v: v > 0)))]

    row = outcomes.items.agg(F.count("*"), *bounds("perf"), *bounds("cost")).first()
    terms = max(1, row[0] * len(outcomes.models))

    def scale(name: str, most: float | None, least: float | None) -> float:
        if not most:
            return 1.0
        power = math.floor(math.log10(2.0**62 / terms) - math.log10(most))
        unit = 10.0 ** max(-300, min(300, power))
        if least * unit < LEAST_UNITS:
            raise ValueError(f"{name} values from {least} to {most} are too far apart to be summed exactly over {row[0]} items")
        return unit

    return scale("performance", row[1], row[2]), scale("cost", row[3], row[4])


def normalised_costs(outcomes: Outcomes) -> DataFrame:
    """Mean cost per model over the largest of these means (1 if that is not positive)."""
    m = len(outcomes.models)
    means = outcomes.items.agg(
        F.array(*[F.avg(F.get("cost", F.lit(j))) for j in range(m)]).alias("means")
    )
    top = F.array_max("means")
    names = F.array(*[F.lit(name) for name in outcomes.models])
    return means.select(
        F.when(top > 0, top).otherwise(F.lit(1.0)).alias("top"),
        F.posexplode("means").alias("model_idx", "mean_cost"),
    ).select(
        "model_idx",
        F.get(names, F.col("model_idx")).alias("model"),
        "mean_cost",
        (F.col("mean_cost") / F.col("top")).alias("cost_norm"),
    )
