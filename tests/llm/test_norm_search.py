from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from tollgate.llm import norm_search as ns

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, item_id string, score string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    tfs = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in tfs]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in tfs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms(text))
    rows = []
    for item, query in queries.items():
        scores = []
        for (doc_id, _), c, n in zip(docs, tfs, sizes):
            m = 75 + 25 * n * n_docs // length if length else 0
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in query.items()
                if c[t]
            )
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        rows += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(rows, key=repr)


def ranked(spark, docs, items, **settings):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in ns.ranked_documents(d, q, **settings).collect()), key=repr)


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"W{i}" for i in range(300)] + ["Été", "漢字", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ,".join(draw.choices(words, weights, k=int(draw.paretovariate(0.8) * 3)))) for i in range(n)], draw, words


def test_against_brute_force(spark, odd_texts):
    docs, draw, words = corpus(700, 1)
    docs += [(None, "w1 w2 w3"), (None, None), (3, "w1 w2 w3")] + [(1000 + i, "w5 w6 W7 w5") for i in range(300)]
    docs += [(5000 + i, t) for i, t in enumerate(odd_texts)]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(40)] + [(50, docs[5][1]), (51, "w5 w6"), (52, None), (53, "nowhere")]
    items += [(51, "w7"), (None, "w1 été"), (55, "漢字 same words"), (55, "漢字 same words")]
    expected = brute(docs, items, 20)
    assert ranked(spark, docs, items) == expected
    assert ranked(spark, docs, items, query_bytes=2000) == expected
    assert ranked(spark, docs, items, k=3) == brute(docs, items, 3)


def test_buckets_and_rows_are_pruned():
    """Short vectors behind long ones are cut off by length, the others by their focus."""
    draw = np.random.default_rng(0)
    packed = ns.PackedQueries([1], {}, [np.array([0, 1])], [np.array([2, 1])], np.array([900, 400, 300])).prepared()
    roots = np.sqrt(packed.weights.astype("f8"))
    best = ns.Best(1, 2, np.zeros(1, "i8"))

    def bucket(size):
        impacts = draw.integers(1, size, (50, 3))
        norms = np.sqrt((packed.weights * impacts.astype("f8") ** 2).sum(1))
        order = np.argsort(-norms)
        ids = np.column_stack([np.arange(50), np.zeros(50, "i8")])
        return ns.Bucket(ids, norms[order], np.full(50, 3), np.tile(np.arange(3), 50), impacts[order].ravel()), impacts[order]

    long, impacts = bucket(1000)
    ns.search_bucket(long, packed, roots, best)
    scores = impacts[:, 0] * 1800 + impacts[:, 1] * 400
    assert sorted(best.rows[0][:, 0]) == sorted(scores)[-2:]
    short, _ = bucket(20)
    short.postings = None  # is not looked into
    ns.search_bucket(short, packed, roots, best)


def test_parts_that_follow_each_other_in_a_batch(spark):
    """Long vectors behind the short ones of another part are searched all the same."""
    queries = ns.PackedQueries([1], {}, [np.array([0])], [np.array([1])], np.array([400]))
    parts = [(i, 20.0 * x, [0], [x]) for i, x in enumerate([9, 8, 7, 100, 90, 3])]
    rows = spark.createDataFrame(parts, "doc_id long, norm double, terms array<int>, impacts array<int>").coalesce(1)
    found = ns.search(rows, queries, np.array([400 * 50]), 2).collect()
    assert sorted(tuple(r) for r in found) == [(1, 3, 40_000), (1, 4, 36_000)]


def test_length_of_a_short_vector_behind_long_ones(spark):
    """Lengths bound from above whatever lies before them in the batch."""
    rows = [(i, 1, [0], [10**6]) for i in range(500)] + [(900 + i, 10**11, [1], [1]) for i in range(5)]
    vectors = spark.createDataFrame(rows, "doc_id long, n long, terms array<int>, tfs array<int>").coalesce(1)
    weights = np.array([9_000, 1], "i8")
    out = ns.impact_vectors(vectors, 505, 10**8, weights).collect()
    for r in out:
        assert r.norm**2 >= sum(int(weights[t]) * x * x for t, x in zip(r.terms, r.impacts))


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ns.ranked_documents(no_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ns.ranked_documents(docs, items.limit(0)).count() == 0
    assert ns.ranked_documents(docs.where("doc_id = 2"), items).count() == 0
