from __future__ import annotations

import numpy as np
import pytest

from tollgate.llm import tiled_cosine as tc
from tests_llm_helpers import least_of_components

SCHEMA = "vec_id long, embedding array<float>, label int, class string, tile int"


def expected(rows, least=0.98):
    good = {}
    for i, (vec, e, label) in enumerate(rows):
        if label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        good[i] = np.asarray(e, "f4").astype("f8")
    pairs = []
    for i, x in good.items():
        for j, y in good.items():
            if j < i and rows[i][2] == rows[j][2] and len(x) == len(y):
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    pairs.append((i, j))
    links = np.zeros(len(rows), int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    root = least_of_components(range(len(rows)), pairs)
    members = {}
    for i, r in root.items():
        members.setdefault(r, []).append(rows[i][0])
    component = [min((v for v in members[root[i]] if v is not None), default=None) for i in range(len(rows))]
    return sorted(
        ((rows[i][0], int(links[i]), component[i], rows[i][0] == component[i]) for i in range(len(rows))), key=repr
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in tc.cosine_links(df).collect()), key=repr)


def near_rows(n, seed=0, width=24):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 8, width))
    rows = []
    for i in range(n):
        v = centres[draw.integers(len(centres))] + draw.normal(size=width) * draw.choice([0.05, 0.12, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v * draw.uniform(0.1, 9)], int(draw.integers(2))))
    return rows


def test_as_brute_force(spark):
    rows = near_rows(300)
    assert found(spark, rows) == expected(rows)


def test_many_tiles_and_axes(spark, monkeypatch):
    monkeypatch.setattr(tc, "TILE_ROWS", 8)
    monkeypatch.setattr(tc, "AXES", 3)
    rows = near_rows(250, seed=1)
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    some = [0.5, 0.25, -1.0]
    rows = [
        (0, some, 1), (1, some, 1), (1, some, 1), (2, some, None), (3, None, 1), (4, [], 1), (5, [0.0] * 3, 1),
        (6, [nan, 1.0, 1.0], 1), (7, [inf, 1.0, 1.0], 1), (8, [None, 1.0, 1.0], 1), (9, [1e30, 5e29, -2e30], 1),
        (10, [0.5, 0.25], 1), (11, [1.0], 1), (12, [-3.0], 1), (13, [2.0], 1), (None, some, 1), (14, some, 2),
    ]
    assert found(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_hot_vector(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(500)] + [(500 + i, [1.0, 2.0 + i / 1000], 0) for i in range(40)]
    assert found(spark, rows) == expected(rows)


def test_early_stop_loses_no_pair():
    draw = np.random.default_rng(2)
    a = tc.unit(draw.normal(size=(40, 3)) @ draw.normal(size=(3, 40)))
    x, y = tc.near_pairs(a, a, 0.9, True)
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(a @ a.T >= 0.9, 1)))}
    assert true <= set(zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("size", [1e160, 1.0, 1e-170])
def test_squares_beyond_doubles(spark, size):
    rows = spark.createDataFrame(
        [(0, [size, 0.0], 1), (1, [size, size / 100], 1), (2, [0.0, size], 1)],
        "vec_id long, embedding array<double>, label int",
    )
    links = {r.vec_id: (r.n_links, r.component_id) for r in tc.cosine_links(rows).collect()}
    assert links == {0: (1, 0), 1: (1, 0), 2: (0, 2)}
