import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.functions import vectors as v
from tollgate.operators import fusion
from tollgate.operators.encode import encode, hashed_terms, or_zero
from tollgate.operators.terms import TfidfModel, top_terms
from tollgate.sources.images import image_vectors, read_images, with_image_vectors

SCHEMA = "item_id long, text_emb array<float>, img_emb array<float>"


def vectors(spark, text, img):
    rows = [(i, list(map(float, t)), None if j is None else list(map(float, j))) for i, (t, j) in enumerate(zip(text, img))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def matrix(df, column="x"):
    return np.array([r[0] for r in df.orderBy("item_id").select(column).collect()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    scale = rng.uniform(0.5, 4, (40, 1))
    return (rng.normal(size=(40, 6)) * scale).astype("f4"), (rng.normal(size=(40, 8)) * scale).astype("f4")


def adaptive(t, i, eps=1e-8):
    d = min(t.shape[1], i.shape[1])
    t, i = t[:, :d].astype(float), i[:, :d].astype(float)

    def confidence(x):
        mu, norms = x.mean(axis=0), np.linalg.norm(x, axis=1)
        s = x @ mu / (norms * np.linalg.norm(mu) + eps)
        z = (norms - norms.mean()) / (norms.std() + eps)
        return np.clip(0.5 * (s + 1) / 2 + 0.5 / (1 + np.exp(-z)), 0, 1)

    et, ei = np.exp(5 * confidence(t)), np.exp(5 * confidence(i))
    wt, wi = (et / (et + ei + eps))[:, None], (ei / (et + ei + eps))[:, None]
    f = wt * t + wi * i + 0.5 * t * i + 0.5 * np.abs(t - i)
    return f / (np.linalg.norm(f, axis=1, keepdims=True) + eps)


def test_adaptive_fusion(spark, data):
    got = matrix(fusion.adaptive_fusion(vectors(spark, *data)))
    assert got == pytest.approx(adaptive(*data), abs=1e-9)


def test_adaptive_fusion_of_a_part_with_given_stats(spark, data):
    df = vectors(spark, *data)
    stats = fusion.batch_statistics(df)
    part = matrix(fusion.adaptive_fusion(df.where("item_id < 5"), stats))
    assert part == pytest.approx(adaptive(*data)[:5], abs=1e-9)


def test_unit_norms_do_not_turn_rounding_into_weights(spark, data):
    unit = [(x / np.linalg.norm(x, axis=1, keepdims=True)) for x in (data[0], data[1][:, :6])]
    one = matrix(fusion.adaptive_fusion(vectors(spark, *unit).coalesce(1)))
    many = matrix(fusion.adaptive_fusion(vectors(spark, *unit).repartition(7)))
    assert one == pytest.approx(many, abs=1e-12)


def test_modality_flags(spark, data):
    t, i = data[0].astype(float), data[1].astype(float)
    df = vectors(spark, *data)
    assert matrix(fusion.average_features(df, "1")) == pytest.approx(t)
    assert matrix(fusion.average_features(df, "2")) == pytest.approx((t + i[:, :6]) / 2)
    assert matrix(fusion.average_features(df, "3")) == pytest.approx(i)
    assert matrix(fusion.adaptive_features(df, "1")) == pytest.approx(t)
    assert matrix(fusion.adaptive_features(df, "3")) == pytest.approx(adaptive(*data), abs=1e-9)
    # both vectors whole; product and distance over the dimensions they share
    crossed = np.hstack([t, i, t * i[:, :6], np.abs(t - i[:, :6])])
    assert matrix(fusion.cross_features(df, "3")) == pytest.approx(crossed)
    assert matrix(fusion.cross_features(df, "1")) == pytest.approx(np.hstack([t, 0 * i, 0 * t, np.abs(t)]))


def test_absent_image_is_zero(spark):
    df = vectors(spark, [[1, 2], [3, 4]], [None, [5, 6]])
    assert matrix(fusion.average_features(df)).tolist() == [[0.5, 1.0], [4.0, 5.0]]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>")
    rows = df.select(v.norm(F.col("a")), v.l2_normalise(F.col("a")), v.dot(F.col("a"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(5.0, [0.6, 0.8], 25.0), (0.0, [0.0, 0.0], 0.0)]


TEXTS = ["The cat, the CAT_1 a sat", "cat the", "", None, "ünï code ünï", "x y z"]


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, question string").repartition(3)


def counts_by_hand():
    import regex

    out = {}
    for i, text in enumerate(TEXTS):
        found = regex.findall(r"[\p{L}\p{N}_]{2,}", (text or "").lower())
        for term in found + [f"{a} {b}" for a, b in zip(found, found[1:])]:
            out[i, term] = out.get((i, term), 0) + 1
    return out


def test_terms(spark):
    counts = counts_by_hand()
    expected = {}
    for (_, term), tf in counts.items():
        frequency, docs = expected.get(term, (0, 0))
        expected[term] = frequency + tf, docs + 1
    got = top_terms(documents(spark), "question")
    assert {r.term: (r.frequency, r.docs) for r in got.collect()} == expected
    top = top_terms(documents(spark), "question", 3).collect()
    assert [(r.term, r.frequency, r.docs) for r in top] == [("the", 3, 2), ("cat", 2, 2), ("cat the", 2, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan.split("Project")[0] and "hashpartitioning(doc" not in plan


def test_tfidf(spark, tmp_path):
    path = str(tmp_path / "vocabulary")
    TfidfModel.fit(documents(spark), path=path, max_terms=5)
    model = TfidfModel.load(spark, path)
    counts = counts_by_hand()
    frequency, docs = {}, {}
    for (_, term), tf in counts.items():
        frequency[term] = frequency.get(term, 0) + tf
        docs[term] = docs.get(term, 0) + 1
    kept = sorted(frequency, key=lambda t: (-frequency[t], t))[:5]
    raw = {k: tf * (math.log(7 / (1 + docs[k[1]])) + 1) for k, tf in counts.items() if k[1] in kept}
    length = {}
    for (doc, _), w in raw.items():
        length[doc] = length.get(doc, 0) + w * w
    expected = {k: w / math.sqrt(length[k[0]]) for k, w in raw.items()}
    got = {(r.doc, r.term): r.weight for r in model.weights(documents(spark)).collect()}
    assert got == pytest.approx(expected)
    sparse = {r.doc: dict(zip(r.indices, r["values"])) for r in model.vectors(documents(spark)).collect()}
    names = sorted(kept)
    assert set(sparse) == set(range(len(TEXTS)))
    assert {(d, names[j]): w for d, row in sparse.items() for j, w in row.items()} == pytest.approx(expected)


def test_projection_keeps_products(spark, tmp_path):
    model = TfidfModel.fit(documents(spark), path=str(tmp_path / "all"))
    sparse = {r.doc: dict(zip(r.indices, r["values"])) for r in model.vectors(documents(spark)).collect()}
    width = 4096
    rows = {r.doc: np.array(r.vector) for r in model.projected(documents(spark), width).collect()}
    again = {r.doc: np.array(r.vector) for r in model.projected(documents(spark).coalesce(1), width).collect()}
    for a in sparse:
        assert len(rows[a]) == width and (rows[a] == again[a]).all()
        for b in sparse:
            exact = sum(w * sparse[b].get(j, 0.0) for j, w in sparse[a].items())
            assert rows[a] @ rows[b] == pytest.approx(exact, abs=0.12)


def test_encoder_batches_do_not_change_the_result(spark):
    df = documents(spark)
    small = matrix(encode(df, "question", hashed_terms(16), "x", batch_size=1))
    large = matrix(encode(df.coalesce(1), "question", hashed_terms(16), "x"))
    assert (small == large).all()
    assert np.linalg.norm(small, axis=1) == pytest.approx([1, 1, 0, 0, 1, 0], abs=1e-6)
    raw = matrix(encode(df, "question", hashed_terms(16), "x", normalise=False))
    assert raw.sum(axis=1).tolist() == [9, 3, 0, 0, 5, 0]


def test_readable_images_stay_in_batches():
    calls = []

    def encoder(values):
        calls.append(len(values))
        if b"broken" in values:
            raise OSError("not an image")
        return np.ones((len(values), 2))

    lenient = or_zero(encoder, 2)
    assert lenient([b"x"] * 64).sum() == 128 and calls == [64]
    values = [b"x"] * 31 + [b"broken", None]
    assert lenient(values).sum() == 62 and len(calls) < 14


def test_images(spark, tmp_path):
    def make_byte_encoder():
        def run(contents):
            if any(b"broken" in bytes(c) for c in contents):
                raise OSError("not an image")
            return np.array([[len(c), 1.0] for c in contents])

        return run

    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "b.png").write_bytes(b"broken")
    items = spark.createDataFrame(
        [(0, f"{tmp_path}/a.png"), (1, f"{tmp_path}/b.png"), (2, f"{tmp_path}/none.png"), (3, ""), (4, None), (5, f"{tmp_path}/a.png")],
        "item_id long, img_path string",
    )
    images = read_images(spark, str(tmp_path))
    found = image_vectors(images, make_byte_encoder, 2, normalise=False)
    got = matrix(with_image_vectors(items, found, 2), "img_emb").tolist()
    assert got == [[3, 1], [0, 0], [0, 0], [0, 0], [0, 0], [3, 1]]

    def without_weights():
        def run(contents):
            raise FileNotFoundError("no weights")

        return run

    with pytest.raises(Exception, match="no weights"):
        image_vectors(images, without_weights, 2).collect()
    with pytest.raises(Exception, match="not an image"):
        image_vectors(images, make_byte_encoder, 2, lenient=False).collect()


def test_tfidf_query_takes_what_run_takes(spark, monkeypatch):
    """Full width, sparse, as ``run`` does for the default policy on text."""
    from tollgate.catalog import queries
    from tollgate.plans.run import TextTfidf

    seen, sparse = [], TfidfModel.sparse
    monkeypatch.setattr(TfidfModel, "sparse", lambda *a, **k: seen.append(sparse(*a, **k)) or seen[0])
    queries.tfidf_low_rank(spark, "/root/testdata/sf0.001")
    row = seen[0].first().vector
    assert TextTfidf().whole("linearmf", "11") and not TextTfidf().whole("linearmf", "22")
    assert row.size > 4096 and list(row.indices) == sorted(row.indices)


def test_parts_are_counted_by_one_sort(monkeypatch):
    """Counts as by hand; no place of every word is worked out, which takes several times as long."""
    from collections import Counter

    import pyarrow as pa

    from tollgate.operators import terms

    def refused(*_, **__):
        raise AssertionError("words are sorted with their places")

    monkeypatch.setattr(terms.np, "unique", refused)
    texts = [["a", "b", "a", "b"], [], None, ["b"], ["a", "a", "a"], ["c", "a", "b"]]
    batch = pa.RecordBatch.from_pydict({"id": [0] * 6, "tokens": pa.array(texts, pa.list_(pa.string()))})
    listed = [(t or []) + [f"{x} {y}" for x, y in zip(t or [], (t or [])[1:])] for t in texts]
    frequency, docs = Counter(x for t in listed for x in t), Counter(x for t in listed for x in set(t))
    got = [r for part in terms._counted([batch]) for r in part.to_pylist()]
    assert len(got) == len(frequency)
    assert {r["term"]: (r["frequency"], r["docs"]) for r in got} == {x: (frequency[x], docs[x]) for x in frequency}


def test_terms_in_small_parts(spark, monkeypatch):
    """Parts of a batch, null and empty texts, and texts longer than a part."""
    from tollgate.operators import terms

    rows = [(i, t) for i, t in enumerate(["a1 b2 a1", None, "", "b2", "a1 b2 c3 " * 50, "x"] * 4)]
    docs = spark.createDataFrame(rows, "item_id long, question string").coalesce(1)
    whole = top_terms(docs, "question").collect()
    vectors = TfidfModel.fit(docs, max_terms=4).vectors(docs).orderBy("doc").collect()
    monkeypatch.setattr(terms, "BATCH_WORDS", 4)
    assert top_terms(docs, "question").collect() == whole
    assert TfidfModel.fit(docs, max_terms=4).vectors(docs).orderBy("doc").collect() == vectors
    assert {r.term: (r.frequency, r.docs) for r in whole}["a1 b2"] == (4 + 200, 8)
    assert [r.tf for r in vectors[:3]] == [[2, 1, 1], [], []] and len(vectors) == 24
