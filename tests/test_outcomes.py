import json
import math

import pytest
from pyspark.sql import functions as F

from tollgate.operators.outcomes import (
    Outcomes, check_columns, from_long, from_wide, impute_means, in_units, infer_models,
    model_means, normalised_costs, zero_missing,
)
from tollgate.sources import sinks, tables
from tollgate.sources.synthetic import TOY_MODELS, synthetic_outcomes


def wide(spark):
    return spark.createDataFrame(
        [
            ("a", "q1", "1", "0.5", "0", "NA"),
            ("a", 'q "2"\nline', None, "nan", "1.0", "2"),
            ("b", None, "0", "1e-1", "", "4"),
        ],
        "dataset string, question string, `m.1_correct` string, `m.1_cost` string, `m.0_correct` string, `m.0_cost` string",
    )


def test_models_are_the_pairs_in_order():
    assert infer_models(["b_cost", "b_correct", "a_correct", "a_cost", "c_cost", "x"]) == ("a", "b")


def test_unusable_tables_are_refused():
    with pytest.raises(ValueError, match="no pair"):
        check_columns(["question", "a_cost", "b_correct"])
    with pytest.raises(ValueError, match="question"):
        check_columns(["a_cost", "a_correct"])


def test_wide_to_long(spark):
    outcomes = from_wide(wide(spark))
    assert outcomes.models == ("m.0", "m.1")
    rows = outcomes.long().orderBy("dataset", "question", "model_idx").collect()
    got = [(r.dataset, r.question, r.answer, r.img_path, r.model, r.is_correct, r.cost) for r in rows]
    assert got == [
        ("a", 'q "2"\nline', "", "", "m.0", 1.0, 2.0),
        ("a", 'q "2"\nline', "", "", "m.1", None, None),
        ("a", "q1", "", "", "m.0", 0.0, None),
        ("a", "q1", "", "", "m.1", 1.0, 0.5),
        ("b", "", "", "", "m.0", None, 4.0),
        ("b", "", "", "", "m.1", 0.0, 0.1),
    ]


def test_ids_do_not_depend_on_partitioning(spark):
    one = {r.question: r.item_id for r in from_wide(wide(spark).coalesce(1)).items.collect()}
    many = {r.question: r.item_id for r in from_wide(wide(spark).repartition(7)).items.collect()}
    assert one == many


def test_imputation_uses_all_rows_or_a_part(spark):
    outcomes = from_wide(wide(spark))
    assert model_means(outcomes) == ([0.5, 0.5], [3.0, pytest.approx(0.3)])
    got = {r.question: (r.perf, r.cost) for r in impute_means(outcomes).items.collect()}
    assert got["q1"] == ([0.0, 1.0], [3.0, 0.5])
    assert got['q "2"\nline'] == ([1.0, 0.5], [2.0, pytest.approx(0.3)])
    part = impute_means(outcomes, F.col("dataset") == "a")
    got = {r.question: (r.perf, r.cost) for r in part.items.collect()}
    assert got[""] == ([0.5, 0.0], [4.0, 0.1])


def test_model_without_outcomes_is_refused(spark):
    empty = wide(spark).withColumn("`m.1_cost`".strip("`"), F.lit("NA"))
    with pytest.raises(ValueError, match=r"m\.1"):
        impute_means(from_wide(empty))


def test_zero_missing_and_units(spark):
    items = zero_missing(from_wide(wide(spark))).items
    assert [r.perf for r in items.where("question = ''").collect()] == [[0.0, 0.0]]
    units = in_units(impute_means(from_wide(wide(spark))), 1000, 100).items.where("question = 'q1'").first()
    assert (units.perf, units.cost) == ([0, 1000], [300, 50])


def test_normalised_costs(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 4.0]), (2, [0.0, 0.0], [3.0, 4.0])],
                               "item_id long, perf array<double>, cost array<double>")
    rows = normalised_costs(Outcomes(df, ("x", "y"))).orderBy("model_idx").collect()
    assert [r.cost_norm for r in rows] == [0.5, 1.0]
    free = df.withColumn("cost", F.array(F.lit(0.0), F.lit(-1.0)))
    rows = normalised_costs(Outcomes(free, ("x", "y"))).orderBy("model_idx").collect()
    assert [r.cost_norm for r in rows] == [0.0, -1.0]


def test_long_rows_of_one_hot_item(spark):
    rows = [(1, "d", f"m{i % 3}", i % 2, i) for i in range(300)] + [(2, "d", "m1", 1, 5)]
    long = spark.createDataFrame(rows, "item_id long, dataset string, model string, is_correct int, cost int")
    got = {r.item_id: (r.perf, r.cost) for r in from_long(long, ("m0", "m1", "m2")).items.collect()}
    assert got[1] == ([1.0, 1.0, 1.0], [297.0, 298.0, 299.0])
    assert got[2] == ([None, 1.0, None], [None, 5.0, None])


def write_csv(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_per_dataset_csv(spark, tmp_path):
    write_csv(tmp_path / "one.csv", 'question,img_path,a_correct,a_cost\n"two\nlines, ""x""",i.png,1,0.5\nplain,,0,NA\n')
    write_csv(tmp_path / "two.csv", "question,answer,a_correct,a_cost,b_correct,b_cost\nr,s,1,2,0,3\n")
    (tmp_path / "one").mkdir()
    read = tables.read_outcomes(spark, str(tmp_path), " One + two+", list_images=False)
    assert read.models == ("a", "b")
    rows = {r.question: r for r in read.items.collect()}
    assert rows['two\nlines, "x"'].img_path == f"{tmp_path}/one/i.png"
    assert rows["plain"].img_path == "" and rows["plain"].cost == [None, None]
    assert (rows["r"].dataset, rows["r"].answer, rows["r"].img_path) == ("two", "s", "")
    assert rows["r"].perf == [1.0, 0.0] and rows["plain"].perf == [0.0, None]


def test_relative_images_without_a_folder_hang_on_the_root(spark, tmp_path):
    write_csv(tmp_path / "one.csv", "question,img_path,a_correct,a_cost\nq,i.png,1,1\n")
    read = tables.read_outcomes(spark, str(tmp_path), "one", list_images=False)
    assert read.items.first().img_path == f"{tmp_path}/i.png"


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_outcomes(spark, str(tmp_path), "nothing")
    with pytest.raises(ValueError, match="no data sets"):
        tables.read_outcomes(spark, str(tmp_path), " + ")


MERGED = (
    "dataset_idx,question,a_correct,a_cost\n"
    "MathVista_1,q1,1,1\nSEEDBench2_Plus_2,q2,0,1\nOCRBench_3,q3,1,1\ntoy_4,q4,1,1\nMathVista_5,q5,1,1\n"
)


def test_merged_table_is_taken_only_for_known_names(spark, tmp_path):
    write_csv(tmp_path / "all.csv", MERGED)
    write_csv(tmp_path / "MathVista" / "1.png", "png")
    write_csv(tmp_path / "MathVista" / "1.webp", "webp")
    read = tables.read_outcomes(spark, str(tmp_path), "math-vista+SEEDBench", merged_name="all.csv")
    rows = {r.question: (r.dataset, r.img_path) for r in read.items.collect()}
    assert rows == {
        "q1": ("MathVista", f"{tmp_path}/MathVista/1.png"),
        "q5": ("MathVista", f"{tmp_path}/MathVista/5.jpg"),
        "q2": ("SEEDBenchv2Plus", f"{tmp_path}/SEEDBenchv2Plus/2.jpg"),
    }
    write_csv(tmp_path / "toy.csv", "question,a_correct,a_cost\nq,1,1\n")
    read = tables.read_outcomes(spark, str(tmp_path), "Toy", merged_name="all.csv", list_images=False)
    assert [r.dataset for r in read.items.collect()] == ["toy"]


def test_merged_table_needs_ids(spark):
    with pytest.raises(ValueError, match="dataset_idx"):
        tables.from_merged(spark.range(1), ["mmstar"])


def test_empty_paths_are_back_filled(spark):
    df = spark.createDataFrame([("MathVista_1", ""), ("x_2", None)], "dataset_idx string, img_path string")
    got = {r.dataset_idx: r.img_path for r in tables.backfilled_paths(df, "/r").collect()}
    assert got == {"MathVista_1": "/r/MathVista/1.jpg", "x_2": ""}
    kept = df.withColumn("img_path", F.when(F.col("dataset_idx") == "x_2", "p"))
    assert {r.img_path for r in tables.backfilled_paths(kept, "/r").collect()} == {None, "p"}
    assert tables.backfilled_paths(spark.range(1), "/r").first().img_path == ""


def test_parquet_source(spark, tmp_path):
    wide(spark).write.parquet(f"{tmp_path}/set.parquet")
    read = tables.read_outcomes(spark, str(tmp_path), "set", ending=".parquet", list_images=False)
    assert read.items.count() == 3 and read.models == ("m.0", "m.1")


def test_made_up_outcomes(spark):
    ids = spark.range(4000).withColumnRenamed("id", "item_id")
    outcomes = synthetic_outcomes(ids)
    assert outcomes.models == tuple(sorted(m.name for m in TOY_MODELS))
    perf, cost = model_means(outcomes)
    for m in TOY_MODELS:
        j = outcomes.models.index(m.name)
        assert perf[j] == pytest.approx(m.accuracy - 0.125, abs=0.03)
        assert cost[j] == pytest.approx(m.cost, rel=0.02)
    again = synthetic_outcomes(ids.repartition(9)).items.orderBy("item_id").limit(50).collect()
    assert again == outcomes.items.orderBy("item_id").limit(50).collect()


def test_points_are_saved_per_run(spark, tmp_path):
    points = spark.createDataFrame([(1.0, 0.5), (2.0, 0.75)], "cost double, performance double")
    folder = str(tmp_path / "out")
    sinks.save_points(points, folder, "oracle", "toy", "22")
    sinks.save_points(points, folder, "random", "toy", "22")
    sinks.save_points(points.limit(1), folder, "random", "toy", "22")
    back = spark.read.json(folder).groupBy("router").count().collect()
    assert {(r["router"], r["count"]) for r in back} == {("oracle", 2), ("random", 1)}


def test_summary_json_keeps_nan_and_infinity(spark):
    df = spark.createDataFrame([("r", math.nan, math.inf)], "router string, nauc double, qnc double")
    text = sinks.summary_json(df).first().summary
    got = json.loads(text)
    assert math.isnan(float(got["nauc"])) and math.isinf(float(got["qnc"]))
