import pytest
from pyspark.sql import functions as F

from tollgate.functions import names as n

ROOT = "/data"


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_canonical(spark):
    values = ["OCR-Bench", "SEEDBench2_Plus", " Math Vista ", "", None, "Ünï"]
    assert column(spark, values, n.canonical) == ["ocrbench", "seedbench2plus", "mathvista", "", None, "n"]
    assert [n.canonical_name(x) for x in values[:3]] == ["ocrbench", "seedbench2plus", "mathvista"]


@pytest.mark.parametrize(
    "idx, prefix, folder, path",
    [
        ("SEEDBench2_Plus_0", "SEEDBench2_Plus", "SEEDBenchv2Plus", "/data/SEEDBenchv2Plus/0.jpg"),
        ("SEEDBench2_Plus_7_1", "SEEDBench2_Plus", "SEEDBenchv2Plus", "/data/SEEDBenchv2Plus/7_1.jpg"),
        ("SEEDBench2_Plus", "SEEDBench2_Plus", "SEEDBenchv2Plus", "/data/SEEDBenchv2Plus/Plus.jpg"),
        ("MathVista", "MathVista", "MathVista", "/data/MathVista/MathVista.jpg"),
        ("MathVista_12", "MathVista", "MathVista", "/data/MathVista/12.jpg"),
        ("MathVistaX_1", None, "unknown", ""),
        ("toy_1", None, "unknown", ""),
        ("", None, "unknown", ""),
        (None, None, "unknown", ""),
    ],
)
def test_instance_ids(spark, idx, prefix, folder, path):
    assert column(spark, [idx], n.longest_prefix) == [prefix]
    assert column(spark, [idx], n.folder_of) == [folder]
    assert column(spark, [idx], lambda c: n.default_image_path(c, ROOT + "/")) == [path]


def test_longest_of_nested_prefixes(spark):
    nested = {"A": "a", "A_B": "ab"}
    assert column(spark, ["A_B_1", "A_C", "A_B", "A"], lambda c: n.longest_prefix(c, nested)) == [
        "A_B", "A", "A_B", "A",
    ]


def test_aliases(spark):
    values = ["seedbench", "SEED Bench v2 plus", "seedbench2_plus", "MMSTAR", "toy"]
    assert column(spark, values, n.alias_prefix) == [
        "SEEDBench2_Plus", "SEEDBench2_Plus", "SEEDBench2_Plus", "MMStar", None,
    ]


def test_resolve_path(spark):
    values = ["/abs/x.png", "a.png", "./a/../b.png", "../up.png", "", None]
    got = column(spark, values, lambda c: n.resolve_path(c, F.lit("/root/set")))
    assert got == ["/abs/x.png", "/root/set/a.png", "/root/set/b.png", "/root/up.png", "", ""]
