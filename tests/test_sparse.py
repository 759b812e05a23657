"""Products of sparse rows, and the fits made of them, against dense linear algebra."""

from __future__ import annotations

import numpy as np
import pytest

from tollgate.operators import sparse
from tollgate.operators.sparse import SPARSE, WideRows, leading_directions, least_squares, low_rank_ridge
from tollgate.routers import LinearPolicy, LowRankPolicy

SCHEMA = f"item_id long, x {SPARSE}, perf array<double>, cost array<double>"


def matrix(n, d, seed, rank=None):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)) * (draw.random((n, d)) < 0.2)
    if rank:
        x = draw.standard_normal((n, rank)) @ (draw.standard_normal((rank, d)) * (draw.random((rank, d)) < 0.3))
    x[3] = 0
    x[5] = x[6]
    return x, draw.standard_normal((n, 4)) + 3


def frame(spark, x, y):
    rows = []
    for i, (a, b) in enumerate(zip(x, y)):
        at = np.flatnonzero(a)
        cost = [None if i == 1 else float(b[2]), float(b[3])]
        rows.append((i, (len(a), at.tolist(), a[at].tolist()), [float(b[0]), float("nan") if i == 2 else float(b[1])], cost))
    y = y.copy()
    y[1, 2] = y[2, 1] = 0
    return spark.createDataFrame(rows, SCHEMA).repartition(5), y


@pytest.mark.parametrize("chunk", [sparse.CHUNK, 40])
def test_products(spark, monkeypatch, chunk):
    monkeypatch.setattr(sparse, "CHUNK", chunk)
    x, y = matrix(60, 90, 1)
    df, y = frame(spark, x, y)
    rows = WideRows.of(df)
    v = np.random.default_rng(2).standard_normal((90, 3))
    assert np.allclose(rows.gram_times(v), x.T @ (x @ v))
    n, x_sum, y_sum, xy = rows.sums()
    assert n == 60 and np.allclose(x_sum, x.sum(0)) and np.allclose(y_sum, y.sum(0)) and np.allclose(xy, x.T @ y)
    monkeypatch.setattr(sparse, "BROADCAST_LIMIT_BYTES", 8 * 90)
    assert np.allclose(rows.gram_times(v), x.T @ (x @ v))


@pytest.mark.parametrize("n, d, rank", [(150, 220, 12), (220, 150, 40), (60, 90, 90)])
def test_leading_directions(spark, n, d, rank):
    x, y = matrix(n, d, 3)
    values, vectors = leading_directions(WideRows.of(frame(spark, x, y)[0]), rank)
    expected = np.linalg.svd(x, compute_uv=False)[:rank]
    expected = expected[expected > 1e-4]
    assert np.allclose(np.sqrt(values), expected, rtol=1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)


def test_restarts_and_few_directions(spark, monkeypatch):
    monkeypatch.setattr(sparse, "MOST_COLUMNS", 24)
    monkeypatch.setattr(sparse, "GROWTH", 6)
    x, y = matrix(120, 100, 4)
    df, y = frame(spark, x, y)
    values, _ = leading_directions(WideRows.of(df), 8)
    assert np.allclose(np.sqrt(values), np.linalg.svd(x, compute_uv=False)[:8], rtol=1e-6)
    low, y = matrix(80, 100, 5, rank=7)
    values, _ = leading_directions(WideRows.of(frame(spark, low, y)[0]), 20)
    assert len(values) == np.linalg.matrix_rank(low)


@pytest.mark.parametrize("n, d, most", [(120, 60, 640), (60, 120, 640), (120, 60, 20)])
def test_least_squares(spark, monkeypatch, n, d, most):
    monkeypatch.setattr(sparse, "MOST_COLUMNS", most)
    x, y = matrix(n, d, 6)
    df, y = frame(spark, x, y)
    weights, intercept = least_squares(WideRows.of(df))
    centred = x - x.mean(0)
    shortest = np.linalg.lstsq(centred, y - y.mean(0), rcond=None)[0]
    tolerance = 1e-6 if most == 640 else 1e-4
    assert np.allclose(weights, shortest, atol=tolerance)
    assert np.allclose(intercept, y.mean(0) - x.mean(0) @ shortest, atol=tolerance)


def test_low_rank_ridge_with_rank_below_width(spark):
    x, y = matrix(200, 150, 7)
    df, y = frame(spark, x, y)
    weights, intercept, _ = low_rank_ridge(WideRows.of(df), 10, 1.0)
    v = np.linalg.svd(x)[2][:10].T
    z = x @ v
    zc = z - z.mean(0)
    beta = np.linalg.solve(zc.T @ zc + np.eye(10), zc.T @ (y - y.mean(0)))
    assert np.allclose(weights, v @ beta, atol=1e-6)
    assert np.allclose(intercept, y.mean(0) - z.mean(0) @ beta, atol=1e-6)


def test_policies_on_sparse_rows_and_wide_arrays(spark, monkeypatch):
    """Sparse, wide dense and narrow dense rows give the same predictions."""
    x, y = matrix(150, 40, 8)
    df, _ = frame(spark, x, y)
    dense = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "item_id long, dense array<double>")
    wide = df.join(dense, "item_id").withColumn("x", dense["dense"]).drop("dense")
    for policy in (LinearPolicy(), LowRankPolicy(rank=9)):
        with monkeypatch.context() as patch:
            from tollgate.routers import linear

            expected = {r.item_id: r.perf_pred + r.cost_pred for r in policy.fit(wide).predict(wide).collect()}
            patch.setattr(linear, "MAX_WIDTH", 10)
            for rows in (df, wide):
                got = {r.item_id: r.perf_pred + r.cost_pred for r in policy.fit(rows).predict(rows).collect()}
                assert all(got[i] == pytest.approx(expected[i], abs=1e-6) for i in expected)


def test_chunks_with_frequent_and_rare_columns():
    """Frequent columns are multiplied as a dense matrix, the others entry by entry; both ways add up."""
    x, _ = matrix(80, 120, 9)
    x[:, 40:] *= np.random.default_rng(1).random((80, 80)) < 0.1
    rows, indices = np.nonzero(x)
    ends = np.searchsorted(rows, np.arange(81))
    chunk = sparse._Chunk(ends, indices, x[rows, indices])
    assert 0 < len(chunk.often) < 120 and len(chunk.indices)
    chunk = sparse._Chunk.restored(dict(vars(chunk)))
    v, p, out = np.random.default_rng(2).standard_normal((120, 3)), np.ones((80, 2)), np.zeros((120, 2))
    chunk.add_back(p, out)
    assert np.allclose(chunk.times(v), x @ v) and np.allclose(out, x.T @ p)


def test_projection_is_kept_up_to_date():
    a = np.random.default_rng(3).standard_normal((30, 30))
    a = a @ a.T
    space = sparse.GramSpace(lambda v: a @ v, 30)
    for seed in range(3):
        assert space.grow(np.random.default_rng(seed).standard_normal((30, 4)))
        assert np.allclose(space.h, space.v.T @ a @ space.v)
    space.keep(np.linalg.qr(np.random.default_rng(9).standard_normal((12, 5)))[0])
    assert np.allclose(space.projected(), space.v.T @ a @ space.v)


def test_given_targets_are_not_mended(spark):
    x, y = matrix(20, 10, 10)
    df, _ = frame(spark, x, y)
    sums = WideRows.of(df, sparse.F.array(sparse.F.lit(float("nan")))).sums()[3]
    assert np.isnan(sums).any()


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no train rows"):
        WideRows.of(spark.createDataFrame([], SCHEMA))


def test_directions_take_few_columns():
    """A slowly falling spectrum in a space that fills up: products are counted, not timed."""
    draw = np.random.default_rng(8)
    left = np.linalg.qr(draw.standard_normal((1200, 1000)))[0]
    x = left * (30 / (1 + np.arange(1000)) ** 0.35)

    class Rows:
        width, columns = 1000, 0

        def gram_times(self, v):
            self.columns += v.shape[1]
            return x.T @ (x @ v)

    rows = Rows()
    values, vectors = leading_directions(rows, 128)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:128] ** 2, rtol=1e-8)
    assert np.allclose(vectors.T @ vectors, np.eye(128), atol=1e-9)
    assert rows.columns < 850
