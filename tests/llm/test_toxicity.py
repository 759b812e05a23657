from __future__ import annotations

import random
import zlib

import pytest

from tollgate.llm.toxicity import FEATURES, Lexicon, fit_toxicity, scored_documents, without_toxic


def corpus(n, seed=0):
    """Invented words; toxic texts hold common insults or words of invented roots."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["ba", "lo", "mi", "tur", "en", "sch"]) for _ in range(draw.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = int(draw.random() < 0.25)
        words = [word() for _ in range(draw.randrange(20, 120))]
        if toxic:
            root = draw.choice(["idiot", "pathetic", "zorgh", "quarn"])
            for _ in range(draw.randrange(2, 5)):
                words[draw.randrange(len(words))] = root + (word() if root in ("zorgh", "quarn") else "")
        docs.append((i, " ".join(words), "en", f"s{toxic}"))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(600)
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: t for i, _, t in labels},
    )


def test_held_out_rows_are_told_apart(tables):
    docs, labels, truth = tables
    rows = scored_documents(docs, labels).collect()
    assert len(rows) == 600
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right >= 0.95
    toxic = [r.score for r in held if truth[r.doc_id]]
    clean = [r.score for r in held if not truth[r.doc_id]]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above >= 0.97


def test_held_out_labels_are_not_learned(spark, tables):
    docs, labels, truth = tables
    turned = spark.createDataFrame(
        [(i, 1, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in truth.items()],
        "doc_id long, quality int, toxic int",
    )
    first = sorted((r.doc_id, r.score) for r in scored_documents(docs, labels).collect())
    assert first == sorted((r.doc_id, r.score) for r in scored_documents(docs, turned).collect())


def test_filter_keeps_columns_and_clean_rows(tables):
    docs, labels, truth = tables
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, t in truth.items() if not t}
    assert len(clean & ids) >= 0.99 * len(clean)
    assert len(ids - clean) <= 0.1 * (len(truth) - len(clean))


def test_odd_rows(odd_docs, odd_texts, tables, no_docs, spark):
    docs, labels, _ = tables
    model = fit_toxicity(docs, labels)
    rows = model.score(odd_docs, "probability").collect()
    assert len(rows) == len(odd_texts) + 4
    assert all(0 <= r.probability <= 1 for r in rows)
    assert rows[0].score == "z"  # a column of that name is left alone
    assert model.score(no_docs, "p").count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    found = scored_documents(odd_docs, no_labels).collect()
    assert {(r.score, r.predicted) for r in found} == {(0.0, 0)}
    assert [r.held_out for r in found if r.doc_id is None] == [False, False]
    one_class = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in scored_documents(odd_docs, one_class).collect()} == {1.0}


def test_features():
    known = Lexicon({"zorg": 2.0})
    assert known.features("") == [0.0] * len(FEATURES)
    found = dict(zip(FEATURES, known.features("You are an idiot! ID10T st*pid zorgan, the END?")))
    assert found["insult_hits"] == 1 and found["learned_hits"] == 1 and found["learned_weight"] > 0
    assert found["near_second_person"] > 0 and found["exclaimed_rate"] > 0 and found["asked_rate"] > 0
    assert dict(zip(FEATURES, known.features("you m0ron")))["obfuscated_hits"] == 1


def test_one_text_per_document_whatever_the_order(spark):
    from tollgate.llm.toxicity import _sample

    rows = [(i, t) for i in range(40) for t in ("b", None, "a", "c")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        assert {r.text for r in _sample(docs, labels).collect()} == {"a"}
