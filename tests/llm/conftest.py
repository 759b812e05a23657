from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, score string"


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, long and unusual texts."""
    draw = random.Random(3)
    words = [f"w{draw.randrange(500)}" for _ in range(30_000)]
    return [
        None, "", " \n\t ", "a", "A a", "one two three four", "one two three four five",
        "ONE two  three\tfour\nfive", " leading and trailing ", "x" * 50_000, " ".join(words),
        "é É ß ñ 漢字 😀 \x1c\x1f\x85\xa0 　", "it's I'll don't 1234 5.6 !!! ...\n\n\nend",
        "<|endoftext|> <s> <0x0A> ▁ & &amp;", "same words again and again", "same words again and again",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with null and repeated ids, and extra columns whose names clash."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "x", "y", "z") for i, t in enumerate(odd_texts)]
    rows += [(None, "no id", None, None, None, None, None, None)] * 2 + [rows[6], rows[6]]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
