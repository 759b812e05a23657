"""Outcome and feature tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.operators.outcomes import Outcomes, impute_means, in_units
from tollgate.plans.evaluate import Scales
from tollgate.session import written

PERF_SCALE = 1_000_000

ORDER_MODELS = tuple(f"m{i}" for i in range(1, 8))
ORDER_SCALES = Scales(perf=PERF_SCALE, cost=1)

VECTOR_MODELS = ("v0", "v1", "v2", "v3")
VECTOR_BASE_COSTS = (30, 70, 700, 10_000)
VECTOR_SCALES = Scales(perf=1, cost=1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_outcomes_long(spark: SparkSession, folder: str) -> DataFrame:
    """One outcome per order and line number; an order is an item, a line a model.

    Lines are reduced per order and line number before they meet the orders, so
    an order with very many lines arrives as seven rows.
    """
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.max(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("is_correct"),
            F.min(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cost_cents"),
        )
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("item_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        "is_correct",
        "cost_cents",
    )


def order_outcomes(spark: SparkSession, folder: str) -> Outcomes:
    """Orders gathered per item and written once; means, split and sweeps read from there.

    One shuffle of the lines, on the order key: conditional maxima and minima are combined
    before it, and the orders are joined on the same key. A line number without a model is
    an error.
    """
    number = F.col("l_linenumber")
    correct = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0)
    cents = F.round(F.col("l_extendedprice") * 100).cast("double")
    strange = F.raise_error(F.concat(F.lit("no model for line "), number.cast("string"))).cast("double")
    known = F.when(~number.between(1, len(ORDER_MODELS)), strange)
    each = range(1, len(ORDER_MODELS) + 1)
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(
        F.array(*[F.max((known if i == 1 else F).when(number == i, correct)) for i in each]).alias("perf"),
        F.array(*[F.min(F.when(number == i, cents)) for i in each]).alias("cost"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("dataset")
    )
    items = lines.join(orders, "item_id").select("item_id", "dataset", "perf", "cost")
    return Outcomes(written(items, "orders"), ORDER_MODELS)


def order_units(spark: SparkSession, folder: str) -> Outcomes:
    """Imputed, in whole units: performance in millionths, cost in cents."""
    return in_units(impute_means(order_outcomes(spark, folder)), PERF_SCALE, 1)


def vector_outcomes(spark: SparkSession, folder: str) -> Outcomes:
    """Items with text and image vectors, a given cluster and four models."""
    e = table(spark, folder, "embeddings")
    item, label = F.col("vec_id"), F.col("label").cast("bigint")

    def perf(m: int):
        draw = (item * 7919 + F.lit(m * 104729 + 13)) % 1000
        return (draw < 450 + 100 * m - 25 * ((label + 3 * m) % 10)).cast("bigint")

    def cost(m: int):
        return F.lit(VECTOR_BASE_COSTS[m]) * (800 + (item * 31 + 17 * m) % 401)

    def scaled(v, factor):
        return F.transform(v, lambda x: (x * factor.cast("float")).cast("float"))

    text, img = F.col("embedding"), F.reverse("embedding")
    items = e.select(
        item.alias("item_id"),
        text.alias("text_emb"),
        img.alias("img_emb"),
        scaled(text, 1 + item % 7).alias("text_emb_scaled"),
        scaled(img, 1 + item % 5).alias("img_emb_scaled"),
        F.col("label").alias("cluster"),
        F.array(*[perf(m) for m in range(4)]).alias("perf"),
        F.array(*[cost(m) for m in range(4)]).alias("cost"),
    )
    return Outcomes(items, VECTOR_MODELS)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("text").alias("question"),
        F.col("source").alias("dataset"),
        "lang",
    )
