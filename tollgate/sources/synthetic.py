"""Made-up outcomes for any table of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tollgate.functions.draws import uniform
from tollgate.operators.outcomes import Outcomes


@dataclass(frozen=True)
class MadeUpModel:
    name: str
    accuracy: float
    cost: float


# The models of the toy table.
TOY_MODELS = (
    MadeUpModel("Qwen2.5-VL-3B-Instruct", 0.65, 0.03),
    MadeUpModel("Qwen2.5-VL-7B-Instruct", 0.75, 0.07),
    MadeUpModel("InternVL3-78B", 0.85, 0.70),
    MadeUpModel("gpt-5-2025-08-07", 0.93, 10.0),
)


def synthetic_outcomes(ids: DataFrame, models=TOY_MODELS, seed: int = 42) -> Outcomes:
    """Draw a difficulty per item, then every model's answer and cost.

    A model answers with probability ``accuracy - 0.25 * difficulty``, kept within
    0.05 and 0.99, at 0.8 to 1.2 times its base cost. The draws hang on seed, item
    and model only, so they are the same on any cluster.
    """
    models = sorted(models, key=lambda m: m.name)
    item = F.col("item_id")
    difficulty = uniform(seed, "difficulty", item)

    def perf(m: MadeUpModel):
        chance = F.greatest(
            F.lit(0.05), F.least(F.lit(0.99), F.lit(m.accuracy) - 0.25 * F.col("difficulty"))
        )
        return F.when(uniform(seed, "answer", m.name, item) < chance, 1.0).otherwise(0.0)

    def cost(m: MadeUpModel):
        return F.lit(m.cost) * (0.8 + 0.4 * uniform(seed, "cost", m.name, item))

    items = ids.select("item_id").withColumn("difficulty", difficulty).select(
        "item_id",
        "difficulty",
        F.array(*[perf(m) for m in models]).alias("perf"),
        F.array(*[cost(m) for m in models]).alias("cost"),
    )
    return Outcomes(items, tuple(m.name for m in models))
