from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tollgate.llm import orc_tokens
from tollgate.llm.orc_tokens import WordCache, find_tokens, read_tokens, token_checksums, write_tokens
from tollgate.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def encoded(cache, texts, end=()):
    flat, sizes = cache.encode(pa.array(texts), list(end))
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


TEXTS = [
    "It's THE end. don't!!", "a,b c;  d\n\ne'll", "Ünïcödé É. İstanbul ΑΣ. Σ", "x<|endoftext|>y 12.5 <|startoftext|>", "",
    "...", ". , ., a. A, 7. _. é. É, x\t.y", "e\u0301 \u212b ﬁ ǅ ŉ ß ſ", "w" * 90 + " " + "Ab." * 40, " ", "words words Words WORDS. words,",
]


def test_words_apart_as_whole_texts(library):
    cache = WordCache(library.to_str())
    assert cache.lowers and cache.parts and cache.bare and cache.joint
    for batch in ([t] for t in TEXTS):
        assert encoded(cache, batch, [1]) == [ids(library, t) for t in batch]
    assert encoded(cache, TEXTS + TEXTS, [1]) == [ids(library, t) for t in TEXTS + TEXTS]
    assert encoded(cache, TEXTS) == [ids(library, t)[:-1] for t in TEXTS]
    assert all(len(w) <= orc_tokens.CACHED_LENGTH for w in cache.number)


def test_emptied_cache(library, monkeypatch):
    monkeypatch.setattr(orc_tokens, "CACHE_ENTRIES", 3)
    cache = WordCache(library.to_str())
    for batch in (TEXTS, TEXTS[::-1], TEXTS[2:5]):
        assert encoded(cache, batch, [1]) == [ids(library, t) for t in batch]


def test_few_encodings_are_held_at_once(library, monkeypatch):
    monkeypatch.setattr(orc_tokens, "JOINED", 2)
    cache, asked = WordCache(library.to_str()), []

    class Watched:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

        def __getattr__(self, name):
            return getattr(library, name)

    cache.tokenizer = Watched()
    texts = [" ".join(f"{i}x{i * 7}" for i in range(at, at + 60)) for at in (0, 60)]
    assert encoded(cache, texts, [1]) == [ids(library, t) for t in texts]
    assert len(asked) > 1 and max(asked) <= 16


def test_marks_behind_a_word_make_no_new_word(library):
    cache, asked = WordCache(library.to_str()), []
    real = cache._model_ids
    cache._model_ids = lambda word: asked.append(word) or real(word)
    cache._tokenized = lambda words: asked.extend(words) or WordCache._tokenized(cache, words)
    texts = ["Zqabk### zqabk$$$ zqabk.,% zqabk", "7### <|endoftext|>!! it's?! zqabk'### é*** ǆ### ### x_y"]
    assert encoded(cache, texts, [1]) == [ids(library, t) for t in texts]
    assert [w for w in asked if w.startswith("zqabk") and "'" not in w] == ["zqabk"]


@pytest.mark.parametrize("without", ["normalizer", "added_tokens", "pre_tokenizer"])
def test_tokenizers_with_other_rules(library, without):
    """What the usual rules do not hold for is given to the tokenizer as it stands, or refused."""
    spec = json.loads(library.to_str())
    spec[without] = [] if without == "added_tokens" else None
    other = Tokenizer.from_str(json.dumps(spec))
    if without == "pre_tokenizer":
        with pytest.raises(ValueError, match="white space"):
            WordCache(json.dumps(spec))
        return
    cache = WordCache(json.dumps(spec))
    texts = [t for t in TEXTS if "\t" not in t]
    assert encoded(cache, texts, [1]) == [ids(other, t) for t in texts]


def test_odd_rows_in_order(spark, odd_docs, odd_texts, library):
    path = scratch_path(spark, "odd_tokens")
    write_tokens(odd_docs, VOCABULARY, 1, path)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows[:2]] == [None, None]
    order = [r.doc_id for r in rows[2:]]
    assert order == sorted(order) and len(rows) == len(odd_texts) + 4
    start = 0
    for row in rows:
        assert row.start == start
        start += len(row.ids)
        if row.doc_id is not None:
            assert row.ids == ids(library, odd_texts[row.doc_id])
    for row in token_checksums(read_tokens(spark, path)).where("doc_id is not null").collect():
        expected = ids(library, odd_texts[row.doc_id])
        assert row.n_tokens == len(expected)
        assert row.ids_crc32 == zlib.crc32(np.asarray(expected, "<u4").tobytes())


def test_ids_are_found_with_the_filter_pushed_down(spark, odd_docs, odd_texts, library):
    path = scratch_path(spark, "found_tokens")
    write_tokens(odd_docs, VOCABULARY, 1, path)
    found = find_tokens(spark, path, [12, 99])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert [r.ids for r in found.collect()] == [ids(library, odd_texts[12])]


def test_files_are_orc_with_columns_by_stripe(spark, tmp_path, odd_docs):
    path = str(tmp_path / "tokens")
    write_tokens(odd_docs.union(odd_docs.withColumn("doc_id", F.col("doc_id") + 100)), VOCABULARY, 1, path)
    files = [orc.ORCFile(str(f)) for f in (tmp_path / "tokens").glob("*.orc")]
    assert sum(f.nrows for f in files) == 40 and all(f.nstripes >= 1 for f in files if f.nrows)


def test_no_rows(spark, no_docs):
    path = scratch_path(spark, "no_tokens")
    write_tokens(no_docs, VOCABULARY, 1, path)
    assert token_checksums(read_tokens(spark, path)).count() == 0


def test_words_are_cut_between_letters_and_marks(library):
    cache, asked = WordCache(library.to_str()), []
    cache._tokenized = lambda words: asked.extend(words) or WordCache._tokenized(cache, words)
    texts = ["zqabk,ÉQXYZ (zqabk)", "Éqxyz/zqabk_zqabk <ZQABK>", "zqabk×a Éqxyz÷,"]
    assert encoded(cache, texts, [1]) == [ids(library, t) for t in texts]
    assert [w for w in asked if "zqabk" in w] == ["zqabk", "zqabk×a"]


def test_capitals_do_not_make_a_special_token(library):
    texts = ["x<|ENDOFTEXT|>y", "x<|ENDOFTEXT|>7 a<|endoftext|>,b!", "<|EndOfText|>'s"]
    assert encoded(WordCache(library.to_str()), texts, [1]) == [ids(library, t) for t in texts]


def test_texts_cut_one_by_one(library, monkeypatch):
    monkeypatch.setattr(orc_tokens, "CUT_BYTES", 1)
    cache = WordCache(library.to_str())
    texts = [*TEXTS, "ab", "cd", "", ",", "ef."]
    assert encoded(cache, texts, [1]) == [ids(library, t) for t in texts]
    odd = pa.array(["skipped", *texts], pa.large_string())[1:]
    assert encoded(cache, odd, [1]) == [ids(library, t) for t in texts]


def test_known_words_are_not_given_to_the_tokenizer_again(library):
    cache, asked = WordCache(library.to_str()), []
    cache._tokenized = lambda words: asked.extend(words) or WordCache._tokenized(cache, words)
    for texts in (["one two, 3x", "É"], ["3x four two", "é É one"], ["four é one."]):
        assert encoded(cache, texts, [1]) == [ids(library, t) for t in texts]
    assert len(asked) == len(set(asked))


def test_offsets_are_found_without_the_ids(spark, odd_docs):
    path = scratch_path(spark, "offset_tokens")
    write_tokens(odd_docs, VOCABULARY, 1, path)
    plan = read_tokens(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<part:int,first:bigint,size:int>" in plan
