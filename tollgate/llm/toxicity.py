"""Toxicity of whole texts: boosted trees over dense features, isotonic calibration.

Features are densities of a fixed lexicon of insults and of one learned from labelled
texts (word beginnings that toxic texts have far more often), how near hits stand to
the second person, and rates of capitals, punctuation and obfuscated spelling. The
trees and the calibration are MLlib's; the features are worked out in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from tollgate.llm.common import texts
from tollgate.session import written

# Labelled rows of each class that a model is fitted on, the bound of the training sample.
ROWS_PER_CLASS = 10_000
# Learned beginnings kept, those that tell most first.
TERMS = 2_000
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
TREES, DEPTH, STEP = 20, 3, 0.3
# Words on either side of a hit in which a second person counts as near.
NEAR = 5

# Common insults.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage pathetic
    worthless disgusting clown imbecile retard retarded bastard asshole jerk creep pig
    filth filthy vermin freak shit shitty bullshit fuck fucking fucker bitch whore slut
    dummkopf arschloch trottel depp schlampe abschaum connard salaud ordure abruti
    imbécile débile pute estúpido estúpida imbécil basura puta cabrón gilipollas mierda
    """.split()
)
# Second-person words.
SECOND_PERSON = frozenset(
    """
    you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous
    votre vos tú ti tus usted ustedes vosotros
    """.split()
)
# Digits and signs written for letters.
LEET = str.maketrans("013457@$!", "oieastasi")

_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?[]^_`{|}~«»¿¡“”„’‘…–—"
_INNER = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]")

FEATURES = (
    "log_words", "insult_rate", "insult_hits", "learned_rate", "learned_hits", "learned_kinds",
    "learned_weight", "near_second_person", "second_person_rate", "capital_rate", "shouted_rate",
    "exclaimed_rate", "asked_rate", "sign_rate", "obfuscated_rate", "obfuscated_hits",
)


def beginnings(word: str) -> set[str]:
    """What a lexicon may know of a word: its first four, five and six letters."""
    return {word[:n] for n in (4, 5, 6) if len(word) >= n}


# What most words are.
NOTHING = (False, 0.0, False, False)


class Lexicon(dict):
    """Word -> (insult, weight of learned beginnings, second person), filled on demand."""

    LIMIT = 200_000

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned

    def __missing__(self, raw: str) -> tuple[bool, float, bool, bool]:
        word = raw.strip(_EDGE)
        learned = max((self.learned.get(b, 0.0) for b in beginnings(word)), default=0.0)
        hidden = False
        if _INNER.search(raw):
            plain = "".join(c for c in word.translate(LEET) if c.isalpha())
            hidden = plain in INSULTS and word not in INSULTS
        if len(self) > self.LIMIT:
            self.clear()
        found = (word in INSULTS, learned, word in SECOND_PERSON, hidden)
        self[raw] = found = found if any(found) else NOTHING  # one object for most words
        return found

    def features(self, text: str) -> list[float]:
        """One number per name of ``FEATURES``; all 0 for an empty text."""
        words = text.lower().split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        seen = [self[w] for w in words]
        insults = sum(s[0] for s in seen)
        weights = [s[1] for s in seen if s[1]]
        persons = [i for i, s in enumerate(seen) if s[2]]
        hidden = sum(s[3] for s in seen)
        near = 0
        if persons and (insults or weights or hidden):
            hits = [i for i, s in enumerate(seen) if s[0] or s[1] or s[3]]
            close = {j for i in persons for j in range(i - NEAR, i + NEAR + 1)}
            near = sum(i in close for i in hits)
        kinds = len({w for w, s in zip(words, seen) if s[1]})
        size, raw = len(text), text.split()
        letters = sum(map(str.isupper, text)) if not text.islower() else 0
        shouted = sum(len(w) > 2 and w.isupper() for w in raw) if letters > n / 2 else 0
        signs = sum(text.count(c) for c in "*#@$%&")
        obfuscated = sum(1 for w in words if len(w) > 3 and _odd(w))
        return [
            math.log1p(n), 1000.0 * insults / n, float(min(insults, 50)), 1000.0 * len(weights) / n,
            float(min(len(weights), 50)), float(min(kinds, 50)), sum(weights) / n, near / n * 1000.0,
            1000.0 * len(persons) / n, letters / size, shouted / n, 100.0 * text.count("!") / size,
            100.0 * text.count("?") / size, 100.0 * signs / size, obfuscated / n, float(min(hidden, 50)),
        ]


def _odd(word: str) -> bool:
    return not word.isalpha() and not word.strip(_EDGE).isalpha() and bool(_INNER.search(word))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)).cast("int")


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic, fold, weight)`` of at most about 2 x ``ROWS_PER_CLASS`` rows.

    Held-out rows take no part. Rows are taken by a hash of their id; weights bring the
    classes back to their shares. Of a doc_id with several labels the highest counts, of
    several texts the least, nulls last.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
    counts = known.groupBy("toxic").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(ROWS_PER_CLASS)) / F.col("count")))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.join(F.broadcast(counts), "toxic").where(place < F.col("share"))  # a row per class
    chosen = chosen.select("doc_id", "toxic", "fold", (1.0 / F.col("share")).alias("weight"))
    # bounded by ROWS_PER_CLASS, so it may be sent to the texts
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "fold", "weight").agg(F.min("text").alias("text"))
    return written(rows, "toxicity_sample")


def learned_terms(sample: DataFrame) -> dict[int, dict[str, float]]:
    """Lexicons of word beginnings: under 0 from all rows, under k from all but fold k.

    A beginning is kept when the likelihood-ratio statistic of its presence in toxic and
    other texts is over twice the logarithm of the number of beginnings tried. Only
    the best ``TERMS`` come to the driver, with their counts by fold.
    """
    folds = range(1, FOLDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic, k in zip(texts(batch), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()):
                words = {w.strip(_EDGE) for w in text.lower().split()}
                seen.update((b, toxic, k) for b in {b for w in words for b in beginnings(w)})
            if seen:
                terms, toxic, k = zip(*seen)
                yield pa.RecordBatch.from_pydict(
                    {"term": pa.array(terms), "toxic": pa.array(toxic, pa.int32()), "fold": pa.array(k, pa.int32()),
                     "n": pa.array(list(seen.values()), pa.int64())}
                )

    cells = [(t, k) for t in (0, 1) for k in folds]
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    total = [sum(sizes.get((t, k), 0) for k in folds) for t in (0, 1)]
    per_term = sample.select("text", "toxic", "fold").mapInArrow(count, "term string, toxic int, fold int, n long")
    per_term = per_term.groupBy("term").agg(
        *[F.coalesce(F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == k), F.col("n"))), F.lit(0)).alias(f"c{t}{k}") for t, k in cells]
    )
    per_term = written(per_term, "toxicity_terms")
    tried = per_term.count()
    if not tried or not all(total):
        return {k: {} for k in (0, *folds)}
    toxic = sum((F.col(f"c1{k}") for k in folds), F.lit(0))
    other = sum((F.col(f"c0{k}") for k in folds), F.lit(0))
    ranked = per_term.where(toxic * total[0] > other * total[1]).withColumn("g", _g(toxic, other, *total[::-1]))
    best = ranked.where(F.col("g") > 2 * math.log(tried)).orderBy(F.desc("g"), "term").limit(TERMS).collect()
    out = {}
    for left_out in (0, *folds):
        sums = [sum(n for (t, k), n in sizes.items() if t == side and k != left_out) for side in (0, 1)]
        lexicon = {}
        for row in best:
            a, b = (sum(row[f"c{t}{k}"] for k in folds if k != left_out) for t in (1, 0))
            if sums[0] and sums[1] and a * sums[0] > b * sums[1] and _g_number(a, b, sums[1], sums[0]) > 2 * math.log(tried):
                lexicon[row["term"]] = math.log((a + 0.5) / (sums[1] + 1)) - math.log((b + 0.5) / (sums[0] + 1))
        out[left_out] = lexicon
    return out


def _g(a: Column, b: Column, toxic: int, other: int) -> Column:
    """Likelihood-ratio statistic of a of ``toxic`` against b of ``other`` rows."""
    share = (a + b) / F.lit(float(toxic + other))

    def part(n: Column, size: int) -> Column:
        return F.when(n > 0, n * F.log(n / (size * share))).otherwise(0.0)

    return 2 * (part(a, toxic) + part(b, other))


def _g_number(a: int, b: int, toxic: int, other: int) -> float:
    share = (a + b) / (toxic + other)
    return 2 * sum(n * math.log(n / (size * share)) for n, size in ((a, toxic), (b, other)) if n)


def _features(lexicons: dict[int, dict[str, float]]):
    """Column function: features by text and fold, with the lexicon that fold did not help to make."""

    @F.pandas_udf("array<double>")
    def make(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready = {k: Lexicon(v) for k, v in lexicons.items()}
        for text, k in parts:
            yield pd.Series([ready[int(j)].features(t or "") for t, j in zip(text, k)], dtype=object)

    return make.asNondeterministic()


@dataclass(frozen=True)
class ToxicityModel:
    """Fitted lexicon, trees and calibration; without both classes, a constant."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame, column: str = "score", text: str = "text") -> DataFrame:
        """``docs`` with a score from 0 to 1 of the text in ``column``, in one pass.

        Null and empty texts have all features 0 and the score that goes with them. All
        other columns are kept, whatever their names, and are no inputs.
        """
        if self.trees is None:
            return docs.withColumn(column, F.lit(self.share))
        features = _features({0: self.lexicon})(F.col(text), F.lit(0))
        rows = docs.withColumn("__toxicity_features", array_to_vector(features))
        rows = _margin(self.trees, rows)
        level = self.calibration.transform(rows)
        # a trace of the uncalibrated score keeps the order within a step
        score = 0.999 * F.col("__toxicity_level") + 0.001 * F.col("__toxicity_raw")
        return level.withColumn(column, score).drop(
            "__toxicity_features", "__toxicity_raw", "__toxicity_level", "__toxicity_margin",
            "__toxicity_probability", "__toxicity_class",
        )


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn(
        "__toxicity_raw", F.element_at(vector_to_array("__toxicity_probability"), 2)
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold, at most ``ROWS_PER_CLASS`` per class.

    Features of a training row come from a lexicon learned without its fold; the trees
    see three folds, the calibration the fourth. With too few rows for that the
    calibration takes all. Labels, source, language and id are never features.
    """
    sample = _sample(docs, labels)
    sizes = {r["toxic"]: (r["n"], r["w"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if set(sizes) != {0, 1}:
        return ToxicityModel({}, None, None, float(max(sizes, default=0)))
    share = sizes[1][1] / (sizes[0][1] + sizes[1][1])
    lexicons = learned_terms(sample)
    ready = sample.select(
        F.col("toxic").cast("double").alias("label"), "weight", "fold",
        _features(lexicons)(F.col("text"), F.col("fold")).alias("features"),
    )
    ready = written(ready, "toxicity_features").withColumn("__toxicity_features", array_to_vector("features"))
    folds = {(r["fold"], r["label"]) for r in ready.select("fold", "label").distinct().collect()}
    apart = {(CALIBRATION, 0.0), (CALIBRATION, 1.0)} <= folds and {l for k, l in folds if k != CALIBRATION} == {0.0, 1.0}
    seen = ready.where(F.col("fold") != CALIBRATION) if apart else ready
    learner = GBTClassifier(
        featuresCol="__toxicity_features", labelCol="label", weightCol="weight", maxIter=TREES,
        maxDepth=DEPTH, stepSize=STEP, seed=7, predictionCol="__toxicity_class",
    )
    learner.setRawPredictionCol("__toxicity_margin").setProbabilityCol("__toxicity_probability")
    trees = learner.fit(seen.coalesce(4))  # a bounded sample
    unseen = _margin(trees, ready.where(F.col("fold") == CALIBRATION) if apart else ready)
    calibration = IsotonicRegression(
        featuresCol="__toxicity_raw", labelCol="label", weightCol="weight", predictionCol="__toxicity_level"
    ).fit(unseen.select("__toxicity_raw", "label", "weight"))
    return ToxicityModel(lexicons[0], trees, calibration, share)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    A null ``doc_id`` has no fold: such a row is scored and neither held out nor learned
    from. Rows that repeat each other get the same score. No rows give no rows.
    """
    scored = fit_toxicity(docs, labels).score(docs.select(F.col("doc_id").cast("long"), "text"))
    return scored.select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score is below the threshold; columns unchanged."""
    model = fit_toxicity(docs, labels)
    return model.score(docs, "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
