from __future__ import annotations

import numpy as np
import pytest

from tollgate.llm import ball_topk as bt

SCHEMA = "vec_id long, vector array<long>, rank int, width string"


def expected(rows, queries, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v]
    for q, x in queries:
        if q is None or not x:
            continue
        scored = [(-max(-bt.LONG - 1, min(bt.LONG, sum(a * b for a, b in zip(x, v)))), i) for i, v in good if i != q and len(v) == len(x)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, queries, k=5):
    frame = lambda some: spark.createDataFrame([(*r, 1, "x") for r in some], SCHEMA)
    return sorted(tuple(r) for r in bt.top_products(frame(rows), frame(queries), k).collect())


def some_rows(n, seed=0, width=8):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-40, 40, (n, width))
    vectors[n // 2 : n // 2 + n // 10] = vectors[0]  # ties
    ids = draw.permutation(n * 3)[:n]
    return [(int(i), [int(x) for x in v]) for i, v in zip(ids, vectors)]


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bt, "SHARD_ROWS", 60)
    monkeypatch.setattr(bt, "BLOCK_ROWS", 7)
    monkeypatch.setattr(bt, "LEAF_ROWS", 8)
    rows = some_rows(400)
    assert found(spark, rows, rows[::11]) == expected(rows, rows[::11], 5)


def test_queries_beyond_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bt, "BROADCAST_LIMIT_BYTES", 1)
    monkeypatch.setattr(bt, "BLOCK_ROWS", 5)
    rows = some_rows(100, seed=1)
    assert found(spark, rows, rows[:15]) == expected(rows, rows[:15], 5)


def test_two_widths_beyond_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bt, "BROADCAST_LIMIT_BYTES", 1)
    monkeypatch.setattr(bt, "BLOCK_ROWS", 5)
    monkeypatch.setattr(bt, "SHARD_ROWS", 30)
    rows = some_rows(80, seed=2) + [(i + 1_000, v) for i, v in some_rows(60, seed=3, width=5)]
    queries = rows[:6] + rows[-6:]
    assert found(spark, rows, queries) == expected(rows, queries, 5)


def test_odd_rows(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (2, [3, 4]), (3, None), (4, []), (None, [5, 6]), (5, [1, 1, 1]), (6, [-7, 0])]
    assert found(spark, rows, rows) == expected(rows, rows, 5)
    assert found(spark, rows[:1], rows[:1]) == []
    assert found(spark, [], []) == []


@pytest.mark.parametrize("size", [1 << 20, 1 << 28, (1 << 31) - 1])
def test_large_components(spark, size):
    rows = [(i, [size - i, -size + 2 * i, size // (i + 1)]) for i in range(12)]
    assert found(spark, rows, rows[:4]) == expected(rows, rows[:4], 5)


def test_quantised_floors_doubles(spark):
    df = spark.createDataFrame([([0.1, -0.1, 1.0, -1.0, 0.00390625, None],)], "e array<float>")
    assert df.select(bt.quantised("e").alias("q")).first().q == [25, -26, 256, -256, 1, None]


def test_inner_nodes_are_pruned(monkeypatch):
    """Far groups: whole branches lie below the k-th score and are never opened."""
    monkeypatch.setattr(bt, "LEAF_ROWS", 8)
    draw = np.random.default_rng(4)
    centres = draw.integers(-4_000, 4_000, (32, 6))
    vectors = (centres[:, None, :] + draw.integers(-20, 20, (32, 32, 6))).reshape(-1, 6)
    tree = bt.ball_tree(vectors.astype("f8"))
    assert sorted(tree["order"]) == list(range(1024))
    for node, (start, end) in enumerate(zip(tree["starts"], tree["ends"])):
        far = np.sqrt(((vectors[tree["order"][start:end]] - tree["centres"][node]) ** 2).sum(axis=1)).max()
        assert far <= tree["radii"][node] + 1e-9
    shard, seen = {"ids": np.arange(1024), "vectors": vectors, **tree}, {}
    queries = {"ids": np.arange(0, 1024, 64), "vectors": vectors[::64]}
    query, point, score = bt.search_shard(queries, shard, 3, np.full(16, -bt.LONG - 1), seen)
    for q in range(16):
        mine = [(int(s), int(p)) for s, p in zip(score[query == q], point[query == q])]
        all_ = sorted(((-int(queries["vectors"][q] @ v), i) for i, v in enumerate(vectors) if i != queries["ids"][q]))
        assert sorted((-s, p) for s, p in mine) == all_[:3]
    inner, leaves = (tree["children"][:, 0] >= 0).sum(), (tree["children"][:, 0] < 0).sum()
    assert seen["inner"] < 0.5 * 16 * inner and seen["leaf"] < 0.25 * 16 * leaves


def test_repeated_rows_are_dealt_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(bt, "SHARD_ROWS", 20)
    largest = []
    monkeypatch.setattr(bt, "written", lambda df, name, real=bt.written: largest.append((name, df)) or real(df, name))
    rows = [(1, [3, 4])] * 200 + [(2, [1, 1])]
    assert found(spark, rows, rows[-1:]) == expected(rows, rows[-1:], 5)
    trees = dict(largest)["ball_trees"]
    assert trees.count() >= 8
