from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tollgate.llm.viterbi_count import UnigramCounter, count_tokens, read_vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, bytes_):
    tokenizer = Tokenizer(models.Unigram(list(vocabulary), 0, bytes_))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def large():
    return read_vocabulary(MODEL)


def test_large_vocabulary_as_the_library(large):
    draw, counter, exact = random.Random(2), UnigramCounter(large), library(large, True)
    for _ in range(2000):
        text = "".join(draw.choice("abcde  the in\n\t éß▁漢😀<s>0x1") for _ in range(draw.randrange(40)))
        assert counter(text) == exact(text), text


def test_ties_and_unknown_runs_as_the_library():
    draw = random.Random(3)
    for seed in range(4):
        pieces = ["a", "b", "ab", "abc", "bc", "▁", "▁a", "ca", "cab", "▁ab"] + ["c"] * (seed % 2)
        vocabulary = (("<unk>", 0.0), *((p, -float(draw.randrange(1, 4))) for p in pieces))
        counter, exact = UnigramCounter(vocabulary), library(vocabulary, False)
        for _ in range(1500):
            text = "".join(draw.choice("abcd ") for _ in range(draw.randrange(20)))
            assert counter(text) == exact(text), text


def test_odd_rows(odd_docs, odd_texts, large):
    exact = library(large, True)
    rows = count_tokens(odd_docs, MODEL).collect()
    assert len(rows) == len(odd_texts) + 4
    for row in rows:
        if row.doc_id is not None:
            text = odd_texts[row.doc_id] or ""
            assert (row.n_tokens, row.n_chars) == (exact(text) if text else 0, len(text))


def test_no_rows(no_docs):
    assert count_tokens(no_docs, MODEL).count() == 0
