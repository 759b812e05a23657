import numpy as np
import pytest
from pyspark.sql import functions as F

import naive
from tollgate.plans.run import Features, TextTfidf, run, with_vectors
from tollgate import session
from tollgate.routers import NearestPolicy
from tollgate.session import drop_scratch, scratch_path, written
from tollgate.sources.tables import path_exists
from tollgate.operators.splits import in_domain


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("outcomes")
    rng = np.random.default_rng(0)
    for name in ("alpha", "beta"):
        lines = ["question,answer,img_path,dataset_idx,m.1_correct,m.1_cost,m.0_correct,m.0_cost"]
        for i in range(60):
            word = ["circle", "square", "line"][i % 3]
            right = (int(i % 3 == 0), int(rng.random() < 0.7))
            lines.append(
                f'"how many {word}, ""{name}"" {i % 20}?",{i},{i}.png,{name}_{i},{right[0]},{rng.uniform(1, 2):.4f},'
                f"{right[1]},{rng.uniform(0.1, 0.2):.4f}"
            )
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
        (folder / name).mkdir()
        for i in range(0, 60, 2):
            (folder / name / f"{i}.png").write_bytes(bytes([i % 3 + 1] * (5 + i)))
    return str(folder)


def byte_means():
    def make():
        return lambda contents: np.array([[np.frombuffer(c, "u1").mean(), len(c)] for c in contents])

    return make


def curve(frame):
    return sorted((r.cost, r.performance) for r in frame.collect())


def test_oracle_from_csv(spark, root, tmp_path):
    result, summary = run(spark, root, "alpha+Beta", "oracle", out_folder=str(tmp_path / "out"), list_images=False)
    row = summary.first()
    assert (row.router, row.dataset, row["mode"]) == ("oracle", "alpha+Beta", "22")
    assert [m.model for m in row.single_model] == ["m.0", "m.1"]
    saved = spark.read.json(str(tmp_path / "out" / "points"))
    assert curve(saved) == pytest.approx(np.array(curve(result.points)))
    front = spark.read.json(str(tmp_path / "out" / "frontier"))
    assert curve(front) == pytest.approx(np.array(curve(result.frontier)))
    back = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert back.router == "oracle" and back.frontier_points == front.count()
    assert back.metrics.ps == pytest.approx(row.metrics.ps)


def test_images_need_an_encoder(spark, root):
    with pytest.raises(ValueError, match="image encoder"):
        run(spark, root, "alpha", "knn", "33", list_images=False)


def test_oracle_equals_the_definition(spark, root):
    from tollgate.operators.outcomes import impute_means
    from tollgate.sources.tables import read_outcomes

    items = impute_means(read_outcomes(spark, root, "alpha", list_images=False)).items
    test = items.where(~in_domain(items)).collect()
    perf, cost = [r.perf for r in test], [r.cost for r in test]
    expected = naive.sweep(perf, cost, perf, cost)
    result, summary = run(spark, root, "alpha", "oracle", list_images=False)
    got = sorted((r.threshold, r.cost, r.performance) for r in result.points.collect())
    assert np.array(got) == pytest.approx(np.array(expected), abs=1e-7)
    expected = naive.metrics(
        [(c, p) for _, c, p in expected], np.mean(perf, axis=0), np.mean(cost, axis=0)
    )
    metrics = summary.first().metrics
    assert (metrics.nauc, metrics.ps, metrics.qnc) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("mode", ["11", "22", "33"])
def test_neighbours_on_text_and_images(spark, root, mode):
    features = Features(image=byte_means(), image_dim=2)
    result, _ = run(
        spark, root, "alpha+beta", "knn", mode, policy=NearestPolicy(5), features=features, list_images=False
    )
    assert result.points.count() > 0 and result.metrics.first().ps <= 1


def test_tfidf_features_and_data_set_split(spark, root):
    _, summary = run(
        spark, root, "alpha+beta", "linearmf", "11", split="out", out_share=0.5,
        features=Features(text=TextTfidf(50)), list_images=False,
    )
    assert 0 < summary.first().metrics.ps <= 1
    with pytest.raises(ValueError, match="split"):
        run(spark, root, "alpha", split="sideways")


def test_tfidf_counts_every_row_of_a_shared_text(spark):
    rows = [(i, "same words" if i < 8 else f"other words {i}0", i < 10) for i in range(12)]
    items = spark.createDataFrame(rows, "row_id long, question string, is_train boolean")
    got = with_vectors(items, F.col("is_train"), Features(text=TextTfidf(2, width=None)), "/")
    vectors = {r.row_id: r.text_emb for r in got.collect()}
    # kept terms: "words" in 10 of 10 train texts, "same" (or "same words") in 8
    idf = np.array([np.log(11 / 9) + 1, np.log(11 / 11) + 1])
    assert vectors[0] == pytest.approx(list(idf / np.linalg.norm(idf)), abs=1e-6)
    assert vectors[9] == pytest.approx([0, 1]) and len(vectors) == 12


def test_scratch_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(session, "_named_folder", lambda s: f"{tmp_path}/")
    assert written(spark.range(5).repartition(2), "t").count() == 5
    path = f"{tmp_path}/tollgate/{spark.sparkContext.applicationId}"
    assert path_exists(spark, path)
    drop_scratch(spark)
    assert not path_exists(spark, path)


def test_shared_folder_where_none_is_named(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "_named_folder", lambda s: asked.append(s))
    folder = session.shared_folder(spark)
    assert asked and spark.sparkContext.getCheckpointDir().startswith(folder)

    class Cluster:
        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)


def test_tiny_costs_stay_apart(spark, tmp_path):
    """Costs of 3e-9 and 4e-9, and of 2.1e-8 and 2.4e-8, keep thresholds and means of their own."""
    costs = [(3e-9, 4e-9), (2.1e-8, 2.4e-8)]
    lines = ["question,a_correct,a_cost,b_correct,b_cost"]
    lines += [f"q{i},{int(i % 2)},{costs[i % 2][0]},1,{costs[i % 2][1]}" for i in range(40)]
    (tmp_path / "tiny.csv").write_text("\n".join(lines) + "\n")
    result, _ = run(spark, str(tmp_path), "tiny", "oracle", list_images=False, train_share=0.5)
    thresholds = sorted(r.threshold for r in result.points.collect())
    assert thresholds == pytest.approx([3e-9, 4e-9, 2.1e-8, 2.4e-8], rel=1e-12)
    single = {r.model: r.avg_cost for r in result.baselines.collect()}
    assert 3e-9 < single["a"] < 2.1e-8 and single["a"] != pytest.approx(1e-8, rel=1e-9)


def test_values_too_far_apart_are_refused(spark, tmp_path):
    lines = ["question,a_correct,a_cost,b_correct,b_cost", "q,1,1e-12,0,1e12", "r,0,1e-12,1,1e12"]
    (tmp_path / "far.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match="too far apart"):
        run(spark, str(tmp_path), "far", "oracle", list_images=False, train_share=0.5)
