from __future__ import annotations

import random
import re

import pytest

from tollgate.llm import pivotal_mix as pm

SCHEMA = "doc_id long, text string, source string, size string, key string"


def water_levels(sizes):
    """Targets by repeated sharing, as the definition says."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / weights for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows_of(n, sources, seed):
    draw = random.Random(seed)
    return [
        (i, "w " * int(draw.paretovariate(0.9) * 5), draw.choices(sources, range(1, len(sources) + 1))[0])
        for i in range(n)
    ]


def mixed(spark, rows):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    return pm.copies_by_row(pm.mix_sources(docs)).collect()


def checked(rows, found):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = water_levels(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted(
        (i is None, i or 0, words(t)) for i, t, _ in rows
    )
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + 1
        taken[r.source] += r.copies * r.size
    return taken, target


@pytest.mark.parametrize("sources", [["a", "b", "c", "d", "é", None], ["only"]])
def test_sources_come_near_their_targets(spark, sources):
    rows = rows_of(900, sources, 1)
    taken, target = checked(rows, mixed(spark, rows))
    largest = max(words(t) for _, t, _ in rows)
    for source in taken:
        assert abs(taken[source] - target[source]) <= max(0.02 * target[source], 0.5 * largest)


def test_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(pm, "BLOCK", 3)
    rows = rows_of(300, ["a", "b"], 2)
    taken, target = checked(rows, mixed(spark, rows))
    largest = max(words(t) for _, t, _ in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in taken)


def test_same_for_other_partitions(spark):
    rows = rows_of(200, ["a", "b", "c"], 3)
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    runs = [
        sorted((r.doc_id, r.copies) for r in pm.copies_by_row(pm.mix_sources(d)).collect())
        for d in (docs.coalesce(1), docs.repartition(7))
    ]
    assert runs[0] == runs[1]


def test_odd_rows(spark, odd_docs, odd_texts):
    found = pm.copies_by_row(pm.mix_sources(odd_docs)).collect()
    assert len(found) == odd_docs.count()
    assert {r.doc_id: r.size for r in found if r.doc_id is not None} == {i: words(t) for i, t in enumerate(odd_texts)}
    out = pm.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r.copies for r in found)


def test_rows_alike_share_their_copies(spark):
    rows = [(1, "one two three", "a")] * 500 + [(2, "w " * 3000, "b")]
    taken, target = checked(rows, mixed(spark, rows))
    assert abs(taken["a"] - target["a"]) <= 3


def test_no_rows(no_docs):
    assert pm.copies_by_row(pm.mix_sources(no_docs)).count() == 0
    assert pm.mixed_documents(no_docs).count() == 0


def test_fair_draws(spark):
    """Over many keys, a document's chance is its fraction."""
    rows = [(i, "w w w", "a") for i in range(3000)] + [(9000, "w " * 900, "b")]
    found = [r for r in mixed(spark, rows) if r.source == "a"]
    rate = found[0].target / found[0].source_size
    for third in range(3):
        part = [r.copies for r in found if r.doc_id // 1000 == third]
        assert sum(part) / len(part) == pytest.approx(rate, abs=0.05)


def test_plan_is_native(odd_docs):
    plan = pm.copies_by_row(pm.mix_sources(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_document_keeps_its_chance(spark):
    """Four hundred sources alike, documents of very different sizes: each is taken as often as it should be."""
    sizes = [3000] + [100] * 20 + [7, 1, 250, 9000, 40]
    sources = 400
    rows = [(s * 1000 + i, 1, f"s{s}", size) for s in range(sources) for i, size in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "key long, n long, source string, size long")
    total = sum(sizes)
    targets = spark.createDataFrame([(f"s{s}", total, 0.2 * total) for s in range(sources)], "source string, source_size long, target double")
    taken, words = [0] * len(sizes), [0] * sources
    for r in pm.pivotal_copies(docs, targets).collect():
        assert r.whole == 0 and r.more in (0, 1)
        taken[r.key % 1000] += r.more
        words[r.key // 1000] += r.more * r.size
    error = 3 * (0.2 * 0.8 / sources) ** 0.5
    assert all(abs(t / sources - 0.2) < error for t in taken[:1] + taken[21:])
    assert abs(sum(taken[1:21]) / (20 * sources) - 0.2) < error / 4
    assert all(abs(t / sources - 0.2) < 1.4 * error for t in taken)
    assert abs(sum(words) / sources / total - 0.2) < 0.02


def test_targets_are_met_with_few_documents_of_many_sizes(spark):
    draw = random.Random(8)
    sizes = [int(draw.paretovariate(0.9) * 30) % 20_000 + 1 for _ in range(250)]
    rows = [(s * 1000 + i, 1, f"s{s}", size) for s in range(20) for i, size in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "key long, n long, source string, size long")
    total = sum(sizes)
    targets = spark.createDataFrame([(f"s{s}", total, 1.37 * total) for s in range(20)], "source string, source_size long, target double")
    words = {}
    for r in pm.pivotal_copies(docs, targets).collect():
        words[r.source] = words.get(r.source, 0) + (r.whole + r.more) * r.size
    assert max(abs(w / (1.37 * total) - 1) for w in words.values()) < 0.01
