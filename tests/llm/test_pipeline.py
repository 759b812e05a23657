from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tollgate.llm.common import table  # noqa: E402
from tollgate.llm.prefix_bpe import PrefixCodec, read_ranks  # noqa: E402
from tollgate.session import written  # noqa: E402
from test_pivotal_mix import water_levels, words  # noqa: E402
from test_signature_join import expected  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage got and gave, as rows."""
    docs = table(spark, FOLDER, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), f"test_{name}")
        out[name] = docs
    return out


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_toxicity_only_drops_rows(stages):
    before = {tuple(r) for r in stages["documents"].collect()}
    after = [tuple(r) for r in stages["toxicity"].collect()]
    assert set(after) <= before and len(after) == len(set(after))


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    found = expected(rows)
    kept = sorted(i for i, (n, least) in found.items() if not n or least == i)
    assert sorted(r.doc_id for r in stages["near_copies"].collect()) == kept


def test_mix_meets_targets(stages):
    before = stages["near_copies"].collect()
    sizes, copies = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    taken = dict.fromkeys(sizes, 0)
    for r in stages["mixing"].collect():
        taken[r.source] += words(r.text)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    target = water_levels(sizes)
    largest = max(words(r.text) for r in before)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)


def test_encoding_is_that_of_the_library(stages):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = PrefixCodec(read_ranks(path), public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={}
    )
    texts = {r.doc_id: r.text for r in stages["mixing"].collect()}
    rows = stages["encoding"].collect()
    assert len(rows) == stages["mixing"].count()
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    run = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(run) == key(stages["encoding"])
