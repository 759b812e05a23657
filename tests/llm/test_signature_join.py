from __future__ import annotations

import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tollgate.llm import signature_join as sj
from tollgate.llm.common import components
from tollgate.llm.signature_tree import links
from tests_llm_helpers import least_of_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return frozenset({tuple(words)})
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    pairs = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    least = least_of_components(list(sets), pairs)
    return {i: (len(sets[i]), least[i]) for i in sets}


def corpus(seed=5, families=12, size=14):
    """Families of edited copies of very different closeness, a passage in half of all."""
    draw = random.Random(seed)
    word = lambda: f"v{draw.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(families):
        base = [word() for _ in range(draw.randrange(5, 200))]
        for _ in range(draw.randrange(1, size)):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 20))):
                copy[draw.randrange(len(copy))] = word()
            if draw.random() < 0.3:
                copy = copy + passage
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[1] + " \n", texts[2]]
    draw.shuffle(texts)
    return list(enumerate(texts))


def joined(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in sj.near_duplicates(docs).collect()}


def test_as_brute_force(spark):
    rows = corpus()
    assert joined(spark, rows) == expected(rows)


def test_large_islands_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(sj, "TILE_SETS", 8)
    monkeypatch.setattr(sj, "FREQUENT", 3)
    rows = corpus(seed=6, families=4, size=60)
    assert joined(spark, rows) == expected(rows)


def test_odd_rows(spark, odd_docs, odd_texts):
    rows = sj.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 4
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert found == expected(list(enumerate(odd_texts)))
    kept = sj.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [i for i in range(len(odd_texts)) if found[i][0] == 0 or found[i][1] == i]


def test_no_rows(no_docs):
    assert sj.near_duplicates(no_docs).count() == 0
    assert sj.keep_one_of_each(no_docs).count() == 0


def test_one_passage_and_word_everywhere(spark):
    """A passage of all documents and one group of copies: nothing but the copies links."""
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(300)]
    rows += [(1000 + i, "the same text of a hot group of copies") for i in range(200)]
    draw.shuffle(rows)
    found = joined(spark, rows)
    assert all(found[i][1] == i for i in range(300))
    assert {found[1000 + i][1] for i in range(200)} == {1000}


def test_links_join_what_brute_force_joins():
    draw = np.random.default_rng(0)
    token = lambda n: draw.integers(0, 2**63, int(n), dtype="u8")
    for _ in range(60):
        bases = [np.unique(token(draw.integers(1, 80))) for _ in range(3)]
        sets = []
        for _ in range(int(draw.integers(1, 50))):
            s = bases[int(draw.integers(3))]
            k = int(draw.integers(0, len(s) // 3 + 1))
            sets.append(np.unique(np.concatenate([draw.permutation(s)[: len(s) - k], token(k)])))
        close = []
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(np.intersect1d(x, y))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    close.append((i, j))
        n = len(sets)
        found = links(sets, None, np.arange(n), None, 75)
        assert least_of_components(range(n), found) == least_of_components(range(n), close)
        half = n // 2
        across = links(sets[:half], sets[half:], np.arange(half), np.arange(half, n), 75)
        across = [(i, half + j) for i, j in across]
        apart = [(i, j) for i, j in close if (i < half) != (j < half)]
        assert least_of_components(range(n), across) == least_of_components(range(n), apart)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(60)] + [(7, 7)],
        "random": [(draw.randrange(80), draw.randrange(80)) for _ in range(50)],
        "none": [],
    }[shape]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in found} == least_of_components(nodes, [e for e in edges if e[0] != e[1]])
    assert len(found) == len(nodes)


@pytest.mark.parametrize("buckets", [1, 7, 64, 5000])
def test_shared_counts_of_chunks_in_any_number_of_buckets(buckets):
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 4000).astype("u8")
    parts = [[np.unique(draw.choice(pool, 60)) for _ in range(100)] for _ in range(6)]
    packets = pa.Table.from_batches([batch for sets in parts for batch in sj._packets(sets, buckets)])
    bucket = np.asarray(packets["bucket"])
    found, entries = Counter(), []
    for number in np.unique(bucket):
        here = packets.filter(pa.array(bucket == number))
        names, counts, _, _ = sj._shared_in_bucket(here)
        found.update(dict(zip(names.tolist(), counts.tolist())))
        entries.append(sum(map(len, here["classes"].to_pylist())) // 8)
    everywhere = [s.tolist() for sets in parts for s in sets]
    holders = Counter(x for s in everywhere for x in s)
    assert sorted(found.values()) == sorted(sum(holders[x] > 1 for x in s) for s in everywhere)
    assert max(entries) <= 4 * np.mean(entries) + 20


def test_bytes_a_shingle_hardly_follow_the_buckets():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 1 << 63, 300).astype("u8")) for _ in range(600)]

    def size(buckets):
        batches = list(sj._packets(sets, buckets))
        return sum(len(x) for b in batches for c in ("classes", "own", "who", "hashes") for x in b.column(c).to_pylist())

    shingles = sum(map(len, sets))
    assert size(20) < 6.5 * shingles
    assert size(300) < 11.5 * shingles


def test_ranges_of_a_bucket(monkeypatch):
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 1 << 63, 40).astype("u8")) for _ in range(50)]
    sets = [np.unique(np.concatenate([s, sets[i // 2][:20]])) for i, s in enumerate(sets)]
    packets = pa.Table.from_batches([b for at in (0, 25) for b in sj._packets(sets[at : at + 25], 1)])
    whole = [x.tolist() for x in sj._shared_in_bucket(packets)]
    monkeypatch.setattr(sj, "BUCKET_RANGE", 100)
    assert [x.tolist() for x in sj._shared_in_bucket(packets)] == whole


def test_exact_counts_part_what_passages_join(spark, monkeypatch, tmp_path):
    """Families with a passage that few others have: no tiles of the whole island are paired."""
    monkeypatch.setattr(sj, "TILE_SETS", 8)
    made, write = [], sj.written

    def written(df, name):
        made.append(name)
        return write(df, name)

    monkeypatch.setattr(sj, "written", written)
    draw = random.Random(4)
    rows = []
    for family in range(20):
        own = " ".join(f"f{family}x{j}" for j in range(30))
        passages = [" ".join(f"p{p}y{j}" for j in range(20)) for p in (family, (family + 1) % 20)]
        rows += [" ".join([own, *passages, f"end{family}z{copy}"]) for copy in range(3)]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    assert joined(spark, rows) == expected(rows)
    assert "finer_islands" in made and "tile_pairs" not in made


def test_shuffle_files_go_when_a_table_is_written(spark):
    java = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.getName() for x in (java.getAllFiles().apply(i) for i in range(java.getAllFiles().size()))}
    before = held()
    df = sj.written(spark.range(1000).repartition(7, "id").groupBy((sj.F.col("id") % 5).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := {x for x in held() - before if x.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    assert not left and df.count() == 5
    folder = Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.exists()
    sj.drop_written(df)
    assert not folder.exists()


@pytest.mark.parametrize("repeated", [False, True])
def test_texts_of_rows_that_are_alone_are_not_shuffled(spark, repeated):
    rows = [(i, f"text {i % 8} of some words that copies share") for i in range(12)]
    rows += [rows[0], rows[0], (99, None), (99, None)] if repeated else []
    kept = sj.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8)) + [99, 99] * repeated
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("Aggregate" in plan) == repeated
