from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tollgate.llm.prefix_bpe import PrefixCodec, encode_documents, read_ranks, unit_starts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return PrefixCodec(read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={}
    )


def ids(library, text):
    return library.encode_ordinary(text or "")


def test_random_texts_as_the_library(codec, library):
    draw = random.Random(1)
    letters = "ab eé\n\t \x1c\x85\xa0 　'stre1234 !?. ñ漢😀  the"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
        found = codec.encode(text)
        assert found == " ".join(map(str, ids(library, text))), text
        assert codec.decode(found) == text.encode()


def test_appends_and_edits_give_the_state_of_the_whole(codec):
    draw = random.Random(2)
    some = lambda n: bytes(draw.choice(b"abc the in on er") for _ in range(n))
    for _ in range(500):
        data = some(draw.randrange(300))
        state = codec.state(data)
        cut = draw.randrange(len(data) + 1)
        assert codec.state(data, codec.state(data[:cut])) == state
        start = draw.randrange(len(data) + 1)
        end = draw.randrange(start, min(len(data), start + 9) + 1)
        changed, edited = codec.edited(data, state, start, end, some(draw.randrange(6)))
        assert edited == codec.state(changed)
        assert b"".join(codec.tokens[i] for i in codec.read_off(edited)) == changed


def test_odd_rows(odd_docs, odd_texts, library):
    found = encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(found) == len(odd_texts) + 4
    by_id = {r.doc_id: r for r in found}
    for i, text in enumerate(odd_texts):
        expected, row = ids(library, text), by_id[i]
        assert row.ids == expected and row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_no_rows(no_docs):
    assert encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_units_are_cut_only_behind_other_characters():
    draw = random.Random(3)
    signs = ["a", "é", "語", "’", " ", "\n", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2029", "\u202f", "\u3000"]
    blank = set(" \n\x85\xa0\u1680\u2003\u2029\u202f\u3000")
    for _ in range(500):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(40)))
        expected = [
            len(text[:i].encode()) for i in range(1, len(text)) if text[i] in " \n" and text[i - 1] not in blank
        ]
        assert unit_starts(np.frombuffer(text.encode(), "u1")).tolist() == expected


def test_texts_share_a_buffer(codec, library):
    some = ["", "a b", "", " the  end\n", "x" * 200 + " y", "語　 語"]
    data = "".join(some).encode()
    offsets = np.cumsum([0] + [len(x.encode()) for x in some])
    found, begin = codec.encode_texts(np.frombuffer(data, "u1"), offsets)
    assert [found[a:b].tolist() for a, b in zip(begin, begin[1:])] == [ids(library, x) for x in some]
