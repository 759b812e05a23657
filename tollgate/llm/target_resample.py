"""Importance resampling towards a target: array-scored weights, bracketed cutoff.

Features of a text are its word runs, hashed into buckets. One pass counts the buckets
of the corpus and of the target texts; the logarithms of their ratios are an array of
one entry per bucket, by which a second pass scores every document. The documents with
the highest scores (weight plus Gumbel noise, which is a draw without replacement) are
found without a sort of the corpus: a quantile sketch brackets the cutoff, exact counts
outside prove the bracket or widen it, and only the bracket is sorted. The drawn ones
alone are ranked, in ranges.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tollgate.llm.common import ascii_terms, map_batches, text_bytes
from tollgate.operators.scan import range_buckets, running
from tollgate.session import written

BUCKETS = 10_000
SEED = 2024
# Words that a document needs to be drawn.
LEAST_WORDS = 20
PERCENT = 10
# Values that one bracket may hold when it is sorted.
BRACKET_ROWS = 50_000
# Accuracy of the quantile sketch: ranks are right to one part in so many.
SKETCH = 10_000
# Bytes and entries of a worker's cache of features.
CACHED_BYTES = 48
CACHED = 200_000


class FeatureBuckets(dict):
    """Bucket of a feature, the CRC-32 of its bytes modulo the number; remembers short ones."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[feature] = bucket
        return bucket


@dataclass(frozen=True)
class Features:
    """Runs of ``shortest`` to ``longest`` words, joined by one space, in ``buckets``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = BUCKETS

    def of(self, text: bytes, known: FeatureBuckets) -> tuple[int, np.ndarray]:
        """Number of words and the buckets of all features, repeats counted."""
        words = ascii_terms(text)
        found = []
        for n in range(self.shortest, self.longest + 1):
            runs = words if n == 1 else map(b" ".join, zip(*[words[i:] for i in range(n)]))
            found.append(np.fromiter(map(known.__getitem__, runs), "i8"))
        return len(words), found[0] if len(found) == 1 else np.concatenate(found)

    def counts(self, texts: DataFrame, name: str) -> np.ndarray:
        """Features of all texts by bucket; a task hands on one row per bucket it has seen."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, total = FeatureBuckets(self.buckets), np.zeros(self.buckets, "i8")
            for batch in batches:
                for text in text_bytes(batch):
                    total += np.bincount(self.of(text, known)[1], minlength=self.buckets)
            seen = np.flatnonzero(total)
            if len(seen):
                yield pa.RecordBatch.from_pydict({"bucket": seen.astype("i4"), "n": total[seen]})

        parts = texts.select("text").mapInArrow(count, "bucket int, n long")
        summed = written(parts.groupBy("bucket").agg(F.sum("n").alias("n")), name)
        counts = np.zeros(self.buckets, "i8")
        for row in summed.collect():  # at most one row per bucket
            counts[row.bucket] = row.n
        return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over corpus share, smoothed by one."""
    n = len(corpus)
    s, t = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist())], "i8"
    )


def gumbel(doc_id: int | None, seed: int) -> int:
    """Noise of a document in thousandths; follows its id and the seed alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, features: Features, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)``, one row per row of ``docs``."""

    def score(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        rows = []
        for doc_id, text in zip(ids, text_bytes(batch)):
            n_words, found = features.of(text, known)
            weight = int(gains[found].sum()) // len(found) if len(found) else 0
            rows.append((n_words, len(found), weight, weight + gumbel(doc_id, seed)))
        n_words, n_features, weight, total = zip(*rows)
        return {"doc_id": ids, "n_words": n_words, "n_features": n_features, "weight": weight, "score": total}

    known = FeatureBuckets(features.buckets)  # filled in the worker
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return map_batches(rows, schema, score)


def nth_smallest(df: DataFrame, column: str, n: int) -> int:
    """The exact ``n``-th smallest value (from 1) of an integer column without nulls.

    A quantile sketch brackets it. Counts on both sides of the bracket are exact: if the
    value lies outside, the bracket is widened; if it is one of the two ends, it is found;
    else the search goes on between them, until what is left is small enough to be sorted.
    Every step keeps a share of the rows, however many repeat a value.
    """
    x = F.col(column)
    while True:
        rows = df.count()
        if not 0 < n <= rows:
            raise ValueError(f"{rows} rows have no value number {n}")
        if rows <= BRACKET_ROWS:
            return df.orderBy(column).limit(n).agg(F.max(column)).first()[0]
        reach = 2.0 / SKETCH
        while True:
            shares = [max(0.0, n / rows - reach), min(1.0, n / rows + reach)]
            low, high = df.agg(F.percentile_approx(column, shares, SKETCH)).first()[0]
            below, upto_low, below_high, upto = df.agg(
                F.count_if(x < low), F.count_if(x <= low), F.count_if(x < high), F.count_if(x <= high)
            ).first()
            if below < n <= upto:
                break
            reach *= 4
        if n <= upto_low:
            return low
        if n > below_high:
            return high
        df, n = df.where((x > low) & (x < high)), n - upto_low


def first_rows(df: DataFrame, order: list[str], n: int) -> tuple[Column, Column]:
    """Conditions for the first ``n`` rows by integer columns, and for the others.

    The cutoff is found in the first column; among the rows that share it, in the next.
    """
    chosen, tied = F.lit(False), F.lit(True)
    part = df
    for column in order:
        if n <= 0:
            break
        value = nth_smallest(part, column, n)
        before, same = part.agg(F.count_if(F.col(column) < value), F.count_if(F.col(column) == value)).first()
        chosen = chosen | (tied & (F.col(column) < value))
        tied = tied & (F.col(column) == value)
        n -= before
        if n == same:
            return chosen | tied, ~(chosen | tied)
        part = part.where(F.col(column) == value)
    return chosen, ~chosen


def resample(
    docs: DataFrame,
    target: DataFrame,
    features: Features = Features(),
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents of ``docs(doc_id, text)`` towards ``target(text)``.

    Returns ``(doc_id, n_features, weight, score, rank)`` for every row; ``rank`` counts
    the drawn ones from 1, highest score first, ties to the smaller doc_id (null last);
    the others have none. Of documents with at least ``least_words`` words the floor of
    the share is drawn. A null or empty text has no feature and weight 0; a null doc_id
    draws its noise as an empty one. Rows that repeat a doc_id share their noise and stay
    rows of their own, with fewer features first. No documents give no rows; without target
    texts the gains follow the corpus alone. Extra columns are not looked at.
    """
    gains = bucket_gains(features.counts(docs, "corpus_buckets"), features.counts(target, "target_buckets"))
    scored = score_documents(docs, gains, features, seed).select(
        "*",
        (-F.col("score")).alias("down"),
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    )
    scored = written(scored, "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    size = percent * eligible.count() // 100
    order = ["down", "place", "n_features", "row"]
    drawn, others = first_rows(eligible, order, size)
    enough = F.col("n_words") >= least_words
    key = F.struct(*order).alias("key")
    ranged = range_buckets(
        scored.where(enough & drawn).select("doc_id", "n_features", "weight", "score", F.lit(1).cast("long").alias("rank"), key),
        "key",
        "drawn",
    )
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    ranked = running(ranged, "key", sums=["rank"]).select(*columns)
    rest = scored.where(~enough | others).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest.select(*columns))
