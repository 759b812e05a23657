"""The registered queries on tables where one key or copy holds a third of all rows."""

import os
import shutil
from pathlib import Path

import duckdb
import pytest

from compare import differences

SOURCE = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

pytestmark = pytest.mark.skipif(not SOURCE.is_dir(), reason="no test data")

HOT = {
    "lineitem": "* replace (case when (l_partkey + l_linenumber) % 3 = 0 then 1 else l_orderkey end as l_orderkey)",
    "orders": "* replace (case when o_orderkey % 3 = 0 then '5-LOW' else o_orderpriority end as o_orderpriority)",
    "documents": (
        "* replace (case when doc_id % 3 = 0 then 'src0' else source end as source, "
        "case when doc_id % 3 = 0 then 'same old text, same old words' else text end as text)"
    ),
    "embeddings": (
        "* replace (case when vec_id % 3 = 0 then 3 else label end as label, "
        "case when vec_id % 3 = 0 then first(embedding) over (order by vec_id) else embedding end as embedding)"
    ),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for file in SOURCE.glob("*.parquet"):
        if file.stem in HOT:
            connection.execute(
                f"copy (select {HOT[file.stem]} from '{file}') to '{out}/{file.name}' (format parquet)"
            )
        else:
            shutil.copyfile(file, out / file.name)
    return str(out)


@pytest.mark.parametrize(
    "name",
    [
        "impute_means", "csv_outcomes", "split_in", "oracle_sweep", "metrics_summary", "random_sweep",
        "budget_sweep_given_predictions", "adaptive_fusion", "text_encoder", "tfidf_weights",
        "cluster_profile", "cluster_route_sweep", "knn_neighbours", "knn_sweep", "linear_residuals", "ridge_residuals", "kmeans_router",
    ],
)
def test_query(spark, folder, name):
    rows, found = differences(spark, folder, name)
    assert rows > 0 and not found


def test_straight_distances_by_bounds_are_those_of_all_pairs(monkeypatch):
    """Copies, near copies, far and equal rows: the product rules out rows, the distances stay."""
    import numpy as np

    from tollgate.operators import neighbours as nb

    draw = np.random.default_rng(5)
    train = draw.standard_normal((400, 9)) * 10.0 ** draw.integers(-3, 6, (400, 1))
    train[50:120] = train[7]
    train[120:140] = train[8] * (1 + 1e-13 * np.arange(20))[:, None]
    test = np.vstack([train[::9], draw.standard_normal((30, 9)), np.zeros((2, 9)), draw.integers(0, 2, (20, 9))])
    exact = nb._distances(test, train, "euclidean")
    whole = []
    monkeypatch.setattr(nb, "_distances", lambda *args: whole.append(args))
    for k in (1, 5, 60, 400):
        found = list(nb.top_k(test, train, k, "euclidean"))
        near, dist = np.vstack([n for n, _ in found]), np.vstack([d for _, d in found])
        expected = np.argsort(exact, axis=1, kind="stable")[:, :k]
        assert np.array_equal(near, expected)
        assert np.array_equal(dist, np.take_along_axis(exact, expected, axis=1))
    assert not whole
