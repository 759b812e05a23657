"""Nothing is left out silently: rows, models, cells, decimals, paths and names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tollgate.functions import names as n
from tollgate.operators.outcomes import from_long, number
from tollgate.operators.splits import both_sides, out_of_domain
from tollgate.operators.sweep import budget_sweep


def test_items_without_predictions_stay_in_the_curve(spark):
    schema = "perf_pred array<double>, cost_pred array<double>, perf array<double>, cost array<double>"
    rows = [
        ([0.1, 0.9], [1.0, 2.0], [0.0, 1.0], [10.0, 20.0]),
        (None, None, [1.0, 0.0], [10.0, 20.0]),
        ([0.5, 0.1], None, [1.0, 0.0], [30.0, 20.0]),
    ]
    points = sorted(tuple(r) for r in budget_sweep(spark.createDataFrame(rows, schema)).drop("bucket").collect())
    # at every budget the two items without predictions take model 0
    assert [(p[0], p[1], p[2], p[3]) for p in points] == [(1.0, 3, 2.0, 50.0), (2.0, 3, 3.0, 60.0)]


def test_large_units_do_not_overflow_the_means(spark):
    schema = "perf_pred array<double>, cost_pred array<bigint>, perf array<bigint>, cost array<bigint>"
    scale = 10**15
    rows = [([1.0], [5 * scale], [scale], [5 * scale])] * 1000
    scales = {"perf_scale": 10**15, "cost_scale": 10**17}
    point = budget_sweep(spark.createDataFrame(rows, schema), **scales).collect()[0]
    assert (point.n, point.performance, point.cost) == (1000, 1.0, 0.05)


def test_a_model_that_is_not_listed_is_refused(spark):
    long = spark.createDataFrame([(1, "d", "a", 1, 2), (1, "d", "x", 1, 2)], "item_id int, dataset string, model string, is_correct int, cost int")
    assert from_long(long, ["a", "x"]).items.count() == 1
    with pytest.raises(Exception, match="unknown model: x"):
        from_long(long, ["a", "b"]).items.collect()


@pytest.mark.parametrize("cell", ["abc", "1,5", "--"])
def test_cells_that_are_no_numbers_are_refused(spark, cell):
    df = spark.createDataFrame([("1.5",), (None,), (" NA ",), ("nan",)], "c string")
    assert [r.v for r in df.select(number(F.col("c")).alias("v")).collect()] == [1.5, None, None, None]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([(cell,)], "c string").select(number(F.col("c"))).collect()


@pytest.mark.parametrize(
    ("base", "path", "expected"),
    [
        ("s3a://bucket/x", "a.png", "s3a://bucket/x/a.png"),
        ("s3a://bucket/x", "../a.png", "s3a://bucket/a.png"),
        ("s3a://bucket/x", "../../../a.png", "s3a://bucket/a.png"),
        ("hdfs://host:8020", "./b//a.png", "hdfs://host:8020/b/a.png"),
        ("file:/data/x", "a.png", "file:/data/x/a.png"),
        ("file:///data/x", "a.png", "file:///data/x/a.png"),
        ("/data/x", "s3a://other/a.png", "s3a://other/a.png"),
        ("/data/x", "/y/a.png", "/y/a.png"),
        ("/data/x", "../y/./a.png", "/data/y/a.png"),
        ("data/x", "a.png", "data/x/a.png"),
        ("data/x", "../../../a.png", "../a.png"),
        ("data/x", "", ""),
        ("data/x", None, ""),
    ],
)
def test_paths(spark, base, path, expected):
    df = spark.createDataFrame([(path, base)], "p string, b string")
    assert df.select(n.resolve_path(F.col("p"), F.col("b"))).first()[0] == expected


def test_aliases_name_one_side(spark):
    df = spark.createDataFrame([("SEEDBenchv2Plus",), ("MathVista",), ("seed_bench",)], "dataset string")
    is_train = out_of_domain(["seedbench", "math vista", "MMStar"], share=0.34)
    assert [r[0] for r in df.select(is_train).collect()] == [True, False, True]
    assert both_sides(df, is_train) == (2, 1)
    with pytest.raises(ValueError, match="0 train rows"):
        both_sides(df, out_of_domain(["MMStar", "MathVista"], share=0.5))
