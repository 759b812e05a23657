from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tollgate.llm import target_resample as tr

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    def features(text):
        words = WORD.findall((text or "").translate(UPPER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [features(t) for _, t in docs]
    s = Counter(b for _, f in found for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for (doc_id, _), (n_words, f) in zip(docs, found):
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([n_words, doc_id, len(f), weight, score, None])
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted((tuple(r[1:]) for r in rows), key=repr)


def drawn(spark, docs, target, **settings):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, score string, rank string").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in tr.resample(d, t, **settings).collect()), key=repr)


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["É", "漢字", "A1"]
    return [(i, "-".join(draw.choices(words, k=draw.randrange(60)))) for i in range(n)], draw, words


@pytest.mark.parametrize("bracket", [50_000, 7])
def test_against_brute_force(spark, odd_texts, monkeypatch, bracket):
    monkeypatch.setattr(tr, "BRACKET_ROWS", bracket)
    docs, draw, words = corpus(600, 1)
    docs += [(None, "w1 " * 30), (None, None), (3, "w1 " * 40)] + [(7, "w5 " * 25)] * 90
    docs += [(9000 + i, t) for i, t in enumerate(odd_texts)]
    target = [" ".join(draw.choices(words[:40], k=50)) for _ in range(20)] + [None, ""]
    assert drawn(spark, docs, target) == brute(docs, target)
    two = tr.Features(1, 2, 500)
    assert drawn(spark, docs, target, features=two, percent=35) == brute(docs, target, 2, 500, 35)


def test_nothing_to_draw_from(spark, no_docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert tr.resample(no_docs, target).count() == 0
    docs, *_ = corpus(30, 2)
    assert drawn(spark, docs, []) == brute(docs, [])
    assert drawn(spark, docs, ["w1 w2"], percent=0) == brute(docs, ["w1 w2"], percent=0)
    assert drawn(spark, docs, ["w1 w2"], percent=100) == brute(docs, ["w1 w2"], percent=100)


def test_nth_smallest_with_ties(spark, monkeypatch):
    monkeypatch.setattr(tr, "BRACKET_ROWS", 5)
    monkeypatch.setattr(tr, "SKETCH", 20)
    draw = random.Random(3)
    for values in ([draw.randrange(1000) for _ in range(500)], [4] * 300 + [5] * 300, [draw.choice([1, 1, 1, 2, 9]) for _ in range(400)]):
        df = spark.createDataFrame([(v,) for v in values], "x long").cache()
        for n in (1, 2, len(values) // 3, len(values) // 2, len(values) - 1, len(values)):
            assert tr.nth_smallest(df, "x", n) == sorted(values)[n - 1]
