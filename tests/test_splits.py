import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tollgate.operators import splits
from tollgate.operators.splits import in_domain, out_of_domain


def expected(ids, share, seed=42):
    order = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return set(order[: math.floor(share * len(order) + 1e-9)])


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_exact_share(spark, share):
    df = spark.range(1003).withColumnRenamed("id", "item_id")
    for frame in (df.coalesce(1), df.repartition(6)):
        train = {r.item_id for r in frame.where(in_domain(frame, share)).collect()}
        assert train == expected(range(1003), share)


def test_refined_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(splits, "_DIGITS", 1)
    monkeypatch.setattr(splits, "_COLLECT", 1)
    df = spark.range(500).withColumnRenamed("id", "item_id")
    train = {r.item_id for r in df.where(in_domain(df, 0.3, seed=7)).collect()}
    assert train == expected(range(500), 0.3, 7)


def test_copies_stay_together(spark):
    df = spark.range(10).withColumnRenamed("id", "item_id")
    hot = df.unionAll(spark.range(6000).select(F.lit(3).cast("long").alias("item_id")))
    sides = hot.withColumn("t", in_domain(hot, 0.4)).groupBy("item_id").agg(F.countDistinct("t").alias("n"))
    assert {r.n for r in sides.collect()} == {1}


def test_out_of_domain(spark):
    df = spark.createDataFrame([("MathVista",), ("SEEDBench2_Plus",), ("toy",)], "dataset string")
    split = out_of_domain(["seedbench2plus", "math vista", "TOY"], 0.2)
    assert {r.dataset: r.t for r in df.withColumn("t", split).collect()} == {
        "MathVista": False, "SEEDBench2_Plus": True, "toy": False,
    }
    for names in ([], ["one"], ["a", "A"]):
        with pytest.raises(ValueError):
            out_of_domain(names, 0.2)
