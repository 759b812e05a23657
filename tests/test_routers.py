import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.operators import neighbours as nb
from tollgate.operators.gram import moments
from tollgate.operators.neighbours import NeighbourIndex
from tollgate.operators.outcomes import Outcomes
from tollgate.operators.splits import in_domain
from tollgate.plans import evaluate as ev
from tollgate.routers import (
    ClusterPolicy, CrossModalPolicy, LinearPolicy, LowRankPolicy, NearestPolicy, NetFactorPolicy, NetPolicy,
)
from tollgate.routers import neural
from tollgate.routers.cluster import cluster_profile
from tollgate.routers.neural import Net, Training, pack_shards, train_net

SCHEMA = "item_id long, x array<double>, perf array<double>, cost array<double>"


def items(spark, x, perf, cost, ids=None, partitions=3):
    def cells(row):
        return [None if math.isnan(c) else float(c) for c in row]

    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), cells(a), cells(p), cells(c)) for i, a, p, c in zip(ids, x, perf, cost)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def predicted(df):
    rows = df.orderBy("item_id").collect()
    return np.array([r.perf_pred for r in rows], float), np.array([r.cost_pred for r in rows], float)


def case(seed=0, n=80, d=5, m=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    perf = (x[:, :m] + rng.normal(size=(n, m)) > 0).astype(float)
    cost = rng.uniform(1, 9, (n, m)) + x[:, [0]]
    return x, perf, cost


# ---- neighbours


def nearest_by_hand(test, train, ids, k, metric):
    if metric == "cosine":
        unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
        dist = 1 - unit(test) @ unit(train).T
    else:
        dist = np.linalg.norm(test[:, None] - train[None], axis=2)
    dist = np.round(dist, nb.DECIMALS)
    return [sorted(range(len(train)), key=lambda j: (row[j], ids[j]))[:k] for row in dist]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_neighbours(spark, metric, broadcast):
    x, perf, cost = case(1, 90)
    x = np.round(x)  # many equal distances
    x[(x == 0).all(axis=1)] = 1.0
    perf[::7, 1] = np.nan
    train = items(spark, x[:50], perf[:50], cost[:50], ids=range(100, 150))
    test = items(spark, x[50:], perf[50:], cost[50:])
    index = NeighbourIndex(train, 7, metric, broadcast=broadcast, block_rows=13)
    expected = nearest_by_hand(x[50:], x[:50], range(50), 7, metric)
    rows = index.neighbours(test).orderBy("item_id", "rank").collect()
    assert [r.train_id - 100 for r in rows] == [j for row in expected for j in row]
    got_perf, got_cost = predicted(index.predict(test))
    assert got_perf == pytest.approx(np.array([np.nanmean(perf[j], axis=0) for j in expected]), nan_ok=True)
    assert got_cost == pytest.approx(np.array([cost[j].mean(axis=0) for j in expected]))


def test_blocks_meet_whatever_the_partitions(spark):
    x, perf, cost = case(17, 300)
    train, test = items(spark, x[:120], perf[:120], cost[:120]), items(spark, x[120:], perf[120:], cost[120:])
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        index = NeighbourIndex(train, 6, broadcast=False, block_rows=11)
        got = predicted(index.predict(test))
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    expected = nearest_by_hand(x[120:], x[:120], range(120), 6, "cosine")
    assert got[0].shape == (180, 3)
    assert got[0] == pytest.approx(np.array([perf[j].mean(axis=0) for j in expected]))
    assert got[1] == pytest.approx(np.array([cost[j].mean(axis=0) for j in expected]))


def test_small_steps_give_the_same_neighbours(monkeypatch):
    x, _, _ = case(2, 60)
    whole = np.vstack([n for n, _ in nb.top_k(x, x[:40], 5, "cosine")])
    monkeypatch.setattr(nb, "_MATRIX_CELLS", 100)
    assert (np.vstack([n for n, _ in nb.top_k(x, x[:40], 5, "cosine")]) == whole).all()


def test_hot_ids_and_large_k(spark):
    x, perf, cost = case(3, 30)
    x[10:20] = x[10]
    train = items(spark, x, perf, cost, ids=[*range(10), *[10] * 10, *range(20, 30)])
    test = items(spark, x, perf, cost, ids=[5] * 30)
    results = []
    for broadcast in (True, False):
        index = NeighbourIndex(train, 99, broadcast=broadcast, block_rows=4)
        assert index.k == 30
        perf_pred, cost_pred = predicted(index.predict(test))
        assert perf_pred.shape == (30, 3)
        results.append(perf_pred)
        assert perf_pred == pytest.approx(np.tile(perf.mean(axis=0), (30, 1)))
    with pytest.raises(ValueError):
        NeighbourIndex(train.limit(0), 3)
    with pytest.raises(ValueError):
        NeighbourIndex(train, 3, "manhattan")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_pivots_spare_most_blocks(spark, metric):
    """Groups on a sphere, copies and zero vectors: the broadcast answer with few rows sent."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(30, 6)), 40, axis=0) + 0.02 * rng.normal(size=(1200, 6))
    x[rng.permutation(1200)[:60]] = 0.0
    x[rng.permutation(1200)[:200]] = x[3]
    x = x[rng.permutation(1200)]
    rows = (x, np.ones((1200, 1)), np.ones((1200, 1)))
    train, test = items(spark, *(a[:900] for a in rows)), items(spark, *(a[900:] for a in rows))
    found = {}
    for broadcast in (True, False):
        index = NeighbourIndex(train, 5, metric, broadcast=broadcast, block_rows=50)
        found[broadcast] = [tuple(r) for r in index.neighbours(test).orderBy("item_id", "rank").collect()]
    assert len(found[True]) == 1500 and found[True] == found[False]
    all_blocks = 900 * (300 // 50)
    assert index.sent["train"] < all_blocks / 2 and index.sent["test"] < 300 * (900 // 50) / 2


def test_train_rows_are_scaled_once(monkeypatch):
    x, _, _ = case(5, 60)
    whole, scaled, real = np.vstack([n for n, _ in nb.top_k(x, x[:40], 5, "cosine")]), [], nb._unit
    monkeypatch.setattr(nb, "_MATRIX_CELLS", 100)
    monkeypatch.setattr(nb, "_unit", lambda a: scaled.append(len(a)) or real(a))
    assert (np.vstack([n for n, _ in nb.top_k(x, x[:40], 5, "cosine")]) == whole).all()
    assert sum(scaled) <= 60 + 40


def test_small_blocks_do_not_multiply_the_rows_sent(spark):
    """Scattered vectors, of which no cell can be ruled out: rows are sent a few times, not once per small block."""
    x = np.random.default_rng(12).normal(size=(700, 24))
    rows = (x, np.ones((700, 1)), np.ones((700, 1)))
    train, test = items(spark, *(a[:400] for a in rows)), items(spark, *(a[400:] for a in rows))
    index = NeighbourIndex(train, 7, broadcast=False, block_rows=2)
    found = index.neighbours(test).orderBy("item_id", "rank").collect()
    assert found == NeighbourIndex(train, 7, broadcast=True).neighbours(test).orderBy("item_id", "rank").collect()
    bundles = len(index._by_cell()[1].load)
    assert bundles <= 2 * nb.BUNDLES
    assert index.sent["test"] <= 300 * bundles and index.sent["train"] <= 400 * 2 * 8


def test_large_train_side_is_not_broadcast(spark, monkeypatch):
    from tollgate import session

    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 100)
    assert not NeighbourIndex(items(spark, *case(4)), 5).broadcast


# ---- linear


def test_moments(spark):
    x, perf, cost = case(5)
    perf[3, 1] = np.nan
    z = np.hstack([np.ones((len(x), 1)), x, np.nan_to_num(perf), cost])
    for partitions in (1, 6):
        m = moments(items(spark, x, perf, cost, partitions=partitions))
        assert m.gram == pytest.approx(z.T @ z)
    with pytest.raises(ValueError, match="no train rows"):
        moments(items(spark, x, perf, cost).limit(0))


def test_wide_features_are_refused(spark, monkeypatch):
    from tollgate.operators import gram

    monkeypatch.setattr(gram, "MAX_WIDTH", 8)
    with pytest.raises(ValueError, match="too many"):
        moments(items(spark, *case(5)))


@pytest.mark.parametrize("deficient", [False, True])
def test_least_squares(spark, deficient):
    x, perf, cost = case(6)
    if deficient:
        x[:, 4] = x[:, 0] + x[:, 1]
    df = items(spark, x, perf, cost)
    got_perf, got_cost = predicted(LinearPolicy().fit(df).predict(df))
    centred = x - x.mean(axis=0)
    for got, y in ((got_perf, perf), (got_cost, cost)):
        w = np.linalg.lstsq(centred, y - y.mean(axis=0), rcond=1e-10)[0]
        assert got == pytest.approx(centred @ w + y.mean(axis=0))


@pytest.mark.parametrize("rank", [2, 128])
def test_low_rank_ridge(spark, rank):
    x, perf, cost = case(7)
    x += 1.5
    df = items(spark, x, perf, cost)
    got_perf, got_cost = predicted(LowRankPolicy(rank=rank, alpha=2.0).fit(df).predict(df))
    r = min(rank, 5)
    z = x @ np.linalg.svd(x, full_matrices=False)[2][:r].T
    zc = z - z.mean(axis=0)
    for got, y in ((got_perf, perf), (got_cost, cost)):
        w = np.linalg.solve(zc.T @ zc + 2.0 * np.eye(r), zc.T @ (y - y.mean(axis=0)))
        assert got == pytest.approx(zc @ w + y.mean(axis=0))


# ---- clusters


def test_profile_of_a_hot_cluster(spark):
    x, perf, cost = case(8, 60)
    perf[:5, 0] = np.nan
    labels = np.where(np.arange(60) < 50, 0, 1)
    df = items(spark, x, perf, cost).withColumn("cluster", F.when(F.col("item_id") < 50, 0).otherwise(1))
    rows = {r.cluster: r for r in cluster_profile(df, 3).collect()}
    for c in (0, 1):
        assert rows[c].perf_pred == pytest.approx(list(np.nanmean(perf[labels == c], axis=0)))
        assert rows[c].cost_pred == pytest.approx(list(cost[labels == c].mean(axis=0)))


def test_clusters_are_the_nearest_centres(spark):
    x, perf, cost = case(9, 120)
    df = items(spark, x, perf, cost)
    fitted = ClusterPolicy(clusters=6).fit(df.where("item_id < 60"))
    centres = fitted.centres
    rows = fitted.assign(df).orderBy("item_id").collect()
    nearest = np.linalg.norm(x[:, None] - centres[None], axis=2).argmin(axis=1)
    assert [r.cluster for r in rows] == nearest.tolist()
    perf_pred, _ = predicted(fitted.predict(df))
    train = nearest[:60]
    for i in range(60, 120):
        assert perf_pred[i] == pytest.approx(perf[:60][train == nearest[i]].mean(axis=0))


def lloyd_by_hand(x, k, seed, rounds=100):
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    centres = x[order[:k]].copy()
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres, atol=0):
            break
        centres = moved
    return centres


def test_clusters_are_those_of_lloyd_rounds_for_any_partitions(spark):
    x, perf, cost = case(21, 150)
    for partitions in (2, 7):
        fitted = ClusterPolicy(clusters=7, seed=3).fit(items(spark, x, perf, cost, partitions=partitions))
        assert fitted.centres == pytest.approx(lloyd_by_hand(x, 7, 3), abs=1e-9)


def test_many_copies_hide_no_vectors(spark):
    x, perf, cost = case(11, 1_200)
    x[8:] = 0.0
    fitted = ClusterPolicy(clusters=4).fit(items(spark, x, perf, cost))
    assert len(fitted.centres) == 4
    ids = np.where(np.arange(1_200) < 8, np.arange(1_200), 1_000)  # copies share the id
    assert len(ClusterPolicy(clusters=9).fit(items(spark, x, perf, cost, ids=ids)).centres) == 9


def test_more_clusters_than_rows(spark):
    x, perf, cost = case(10, 6)
    df = items(spark, x, perf, cost)
    assert ClusterPolicy(clusters=20).fit(df).predict(df).count() == 6
    one = df.where("item_id = 0")
    assert predicted(ClusterPolicy().fit(one).predict(df))[0] == pytest.approx(np.tile(perf[0], (6, 1)))
    with pytest.raises(ValueError):
        ClusterPolicy().fit(df.limit(0))


# ---- nets


@pytest.mark.parametrize(
    "net",
    [
        Net((4, 5, 3, 2), (True, True, False)),
        Net((4, 5, 3, 2), (True, False, False), small_last=True),
        Net((4, 6, 4), (True, False), heads=2),
    ],
)
def test_gradient(net):
    rng = np.random.default_rng(0)
    w = net.initial(rng) + rng.normal(0, 0.3, net.size)
    x, y = rng.normal(size=(7, 4)), rng.normal(size=(7, net.widths[-1]))
    y[rng.random(y.shape) < 0.3] = np.nan
    _, grad = net.loss_gradient(w, x, y)
    for i in rng.choice(net.size, 25, replace=False):
        step = np.zeros(net.size)
        step[i] = 1e-6
        slope = (net.loss_gradient(w + step, x, y)[0] - net.loss_gradient(w - step, x, y)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-6)


def test_masked_loss_is_the_mean_over_known_targets():
    net = Net((1, 2), (False,))
    w = np.array([1.0, 2.0, 0.0, 0.0])
    loss, _ = net.loss_gradient(w, np.array([[1.0], [2.0]]), np.array([[0.0, np.nan], [np.nan, 1.0]]))
    assert loss == pytest.approx((1.0 + 9.0) / 2)
    assert net.loss_gradient(w, np.ones((1, 1)), np.full((1, 2), np.nan))[0] == 0.0


FAST = Training(epochs=30, rounds=3, lr=5e-3, shards=1)
LONGER = Training(epochs=90, rounds=3, lr=5e-3, shards=1)


def error(got, truth):
    return float(((got - truth) ** 2).mean())


@pytest.mark.parametrize(
    "policy",
    [
        NetPolicy((16, 8), LONGER),
        NetFactorPolicy((16, 8), 4, LONGER),
        CrossModalPolicy((16, 8), LONGER),
        NetFactorPolicy((16, 8), 4, Training(epochs=250, rounds=10, lr=5e-3, shards=3)),
    ],
)
def test_nets_learn(spark, policy):
    x, _, cost = case(11, 200)
    perf = x[:, :3] * 0.5 + 0.2
    cost = 100 + 40 * x[:, 1:4]
    df = items(spark, x, perf, cost)
    got_perf, got_cost = predicted(policy.fit(df).predict(df))
    assert error(got_perf, perf) < 0.25 * error(perf.mean(axis=0), perf)
    assert error(got_cost, cost) < 0.25 * error(cost.mean(axis=0), cost)


@pytest.mark.parametrize("shards", [1, 5])
def test_same_seed_same_net(spark, shards):
    x, perf, cost = case(12, 300)
    policy = NetPolicy((8,), Training(epochs=30, rounds=3, lr=5e-3, shards=shards))
    first = predicted(policy.fit(items(spark, x, perf, cost)).predict(items(spark, x, perf, cost)))
    again = predicted(policy.fit(items(spark, x, perf, cost, partitions=7)).predict(items(spark, x, perf, cost)))
    assert first[0] == pytest.approx(again[0], abs=1e-12) and first[1] == pytest.approx(again[1], abs=1e-9)


def test_rounds_of_one_shard_change_nothing(spark):
    x, perf, cost = case(13, 50)
    shards, rows = pack_shards(items(spark, x, perf, cost), 1)
    net = Net((5, 8, 6), (True, False))
    flat = np.zeros(6), np.ones(6)
    one = train_net(net, shards, rows, Training(epochs=6, rounds=1), slice(0, 6), *flat)
    many = train_net(net, shards, rows, Training(epochs=6, rounds=6), slice(0, 6), *flat)
    assert one == pytest.approx(many, abs=1e-12)


def test_copies_of_one_item_do_not_fill_a_shard(spark):
    x, perf, cost = case(14, 400)
    shards, rows = pack_shards(items(spark, x, perf, cost, ids=[7] * 400), 8)
    sizes = [r["rows"] for r in shards.collect()]
    assert rows == 400 and sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100


def test_copies_of_one_row_do_not_fill_a_shard(spark):
    x, perf, cost = case(16, 600)
    perf[3, 1] = np.nan
    for part in (x, perf, cost):
        part[:203] = part[3]
    df = items(spark, x, perf, cost, ids=[0] * 203 + list(range(203, 600)))
    packed = [r.asDict() for r in pack_shards(df, 8)[0].collect()]
    held = [np.frombuffer(r["x"], "<f4").reshape(r["rows"], -1) for r in packed]
    copies = [int((h == x[0].astype("f4")).all(axis=1).sum()) for h in held]
    assert sum(copies) == 203 and set(copies) <= {25, 26} and sum(map(len, held)) == 600
    assert np.sort(np.vstack(held), axis=0) == pytest.approx(np.sort(x.astype("f4"), axis=0))
    targets = np.vstack([np.frombuffer(r["y"], "<f8").reshape(r["rows"], -1) for r in packed])
    assert np.isnan(targets).sum() == 203 and targets.shape == (600, 6)


def test_shards_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neural, "SHARD_VALUES", 11 * 20)
    shards, rows = pack_shards(items(spark, *case(17, 600)), 8)
    sizes = [r["rows"] for r in shards.collect()]
    assert rows == sum(sizes) == 600 and max(sizes) <= 40


def test_missing_targets_are_masked(spark):
    x, perf, cost = case(15, 80)
    perf[::2, 1] = np.nan
    cost[::3, 0] = np.nan
    df = items(spark, x, perf, cost)
    for policy in (NetPolicy((8,), FAST), NetFactorPolicy((8,), 4, FAST), CrossModalPolicy((8,), FAST)):
        got = predicted(policy.fit(df).predict(df))
        assert np.isfinite(got[0]).all() and np.isfinite(got[1]).all()


# ---- evaluations


SMALL = {
    "mlp": NetPolicy((8,), FAST),
    "mlpmf": NetFactorPolicy((8,), 4, FAST),
    "cmr": CrossModalPolicy((8,), FAST),
    "kmeans": ClusterPolicy(4),
    "kmeansnew": ClusterPolicy(4),
    "knn": NearestPolicy(9),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    x, perf, cost = case(16, 150)
    rows = [
        (i, list(map(float, a)), list(map(float, a[::-1])), list(map(int, p)), [int(100 * c) + 1000 for c in q])
        for i, (a, p, q) in enumerate(zip(x, perf, cost))
    ]
    schema = "item_id long, text_emb array<float>, img_emb array<float>, perf array<bigint>, cost array<bigint>"
    return Outcomes(spark.createDataFrame(rows, schema), ("a", "b", "c"))


@pytest.mark.parametrize("name", ["oracle", "random", *ev.LEARNED])
def test_every_policy(spark, outcomes, name):
    is_train = in_domain(outcomes.items)
    result = ev.evaluate(name, outcomes, is_train, policy=SMALL.get(name))
    front = sorted((r.cost, r.performance) for r in result.frontier.collect())
    assert front and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(front, front[1:]))
    row = result.metrics.first()
    assert row.ps == pytest.approx(front[-1][1]) and 0 <= row.ps <= 1
    assert result.baselines.count() == 3


@pytest.mark.parametrize("mode", ["11", "12", "21", "33", "13"])
@pytest.mark.parametrize("name", ["knn", "kmeansnew", "cmr"])
def test_modes(spark, outcomes, name, mode):
    is_train = in_domain(outcomes.items)
    points = ev.curve(name, outcomes, is_train, ev.Scales(), mode, SMALL[name])
    assert points.count() > 0


def test_summary_and_comparison(spark, outcomes):
    is_train = in_domain(outcomes.items)
    result = ev.evaluate("oracle", outcomes, is_train)
    row = ev.summary(result, "oracle", "toy", "22").first()
    assert (row.router, row.dataset, row["mode"]) == ("oracle", "toy", "22")
    assert [b.model for b in row.single_model] == ["a", "b", "c"]
    assert row.metrics.ps == pytest.approx(result.metrics.first().ps)
    compared = ev.compare(["oracle", "random", "linear"], outcomes, is_train).collect()
    assert [r.router for r in compared] == ["oracle", "random", "linear"]
    assert compared[0].ps >= compared[2].ps and compared[0].nauc == pytest.approx(row.metrics.nauc)


@pytest.mark.parametrize(("heads", "decay"), [(1, 0.0), (2, 1e-2)])
def test_local_epochs_are_adam_bit_by_bit(heads, decay):
    draw = np.random.default_rng(0)
    x, y = draw.standard_normal((70, 9)), draw.standard_normal((70, 4))
    y[draw.random(y.shape) < 0.2] = np.nan
    net, how = neural.Net((9, 16, 4), (True, False), heads=heads), neural.Training(weight_decay=decay)
    made = []

    class Layers(neural.Net):
        def layers(self, flat):
            made.append(flat)
            return super().layers(flat)

    start = net.initial(draw)
    w, m1, m2, step = start.copy(), 0 * start, 0 * start, 0
    for epoch in range(3):
        order = np.random.default_rng((how.seed, 5, epoch)).permutation(70)
        for at in range(0, 70, how.batch_size):
            _, grad = net.loss_gradient(w, x[order[at : at + how.batch_size]], y[order[at : at + how.batch_size]])
            step += 1
            m1 += (1 - neural.BETA1) * (grad - m1)
            m2 += (1 - neural.BETA2) * (grad * grad - m2)
            w -= how.lr * how.weight_decay * w
            scale = np.sqrt(m2 / (1 - neural.BETA2**step)) + neural.ADAM_EPS
            w -= how.lr * (m1 / (1 - neural.BETA1**step)) / scale
    state = np.concatenate([start, np.zeros(2 * net.size), [0.0]])
    layered = Layers((9, 16, 4), (True, False), heads=heads)
    done = neural._local_epochs(layered, state, x, y, how, range(3), 5)
    assert np.array_equal(done, np.concatenate([w, m1, m2, [step]]))
    assert len(made) == 3 * step  # forward, and weights and gradient of the way back: written in place
