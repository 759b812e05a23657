"""Ranked lexical search over impact vectors ordered by length (LEMP).

A document is a vector of impacts, one per query term that it holds: the term's saturated
frequency times the root of its weight. Vectors are stored longest first and read in
buckets of bounded size. For a query whose k-th best score so far is known, the product
of lengths (Cauchy-Schwarz) ends the buckets and the rows of a bucket; inside, the
query's heaviest coordinates are multiplied out and the rest is bounded by the product
of what is left of both lengths. What survives is scored again exactly, in integers.

The longest vectors of the whole table are searched first; the k-th scores found there go
out to all tasks, and from bucket to bucket within a task they only rise.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tollgate.llm.common import ascii_terms, map_batches, text_bytes
from tollgate.session import written

TOP = 20
# Bytes of query terms that go to every worker at once; more items are searched in blocks.
QUERY_BYTES = 16 * 1024 * 1024
# Rows and coordinates of a bucket.
BUCKET_ROWS = 2_048
BUCKET_NONZEROS = 1_000_000
# Share of the vectors, longest first, that are searched for the first k-th scores.
SEED_SHARE = 0.01
# Share of a query's squared length that is multiplied out before the rest is bounded.
FOCUS = 0.7
# Bounds are doubles: products within this of the k-th score are scored in integers.
SLACK = 1 + 1e-9

NO_ID = 2**63 - 1


@dataclass
class PackedQueries:
    """Items of one block: their terms by number, and how often they hold each."""

    items: list
    vocabulary: dict
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, "i8"))

    def prepared(self) -> PackedQueries:
        """Lengths and focus coordinates, heaviest first, once the weights are known."""
        root = np.sqrt(self.weights.astype("f8"))
        self.norms, self.focus, self.rest, self.factors = np.zeros(len(self.items)), [], [], []
        for i, (terms, counts) in enumerate(zip(self.terms, self.counts)):
            value = counts * root[terms]
            order = np.argsort(-value, kind="stable")
            squares = value[order] ** 2
            total = squares.sum()
            take = int(np.searchsorted(np.cumsum(squares), FOCUS * total)) + 1 if len(order) else 0
            self.norms[i] = math.sqrt(total)
            self.focus.append((terms[order[:take]], value[order[:take]]))
            self.rest.append(math.sqrt(max(0.0, squares[take:].sum())) * SLACK)
            self.factors.append(counts * self.weights[terms])
        return self


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, n)``; texts that share an item_id are one query."""

    def count(batch: pa.RecordBatch) -> dict:
        ids, terms, counts = [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch)):
            for term, n in Counter(ascii_terms(text)).items():
                ids.append(item)
                terms.append(term.decode("utf-8"))
                counts.append(n)
        return {"item_id": ids, "term": terms, "n": counts}

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = map_batches(rows, "item_id long, term string, n long", count)
    return found.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def packed_blocks(items: DataFrame, query_bytes: int = QUERY_BYTES) -> Iterator[PackedQueries]:
    """The items in blocks of about ``query_bytes``, dealt by a hash of their ids."""
    terms = written(item_terms(items), "item_terms")
    size = terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.term))
        vocabulary = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        found: dict = {}
        for r in rows:
            found.setdefault(r.item_id, []).append((vocabulary[r.term], r.n))
        pairs = [np.array(x, "i8").reshape(-1, 2) for x in found.values()]
        if pairs:
            encoded = {t.encode(): i for t, i in vocabulary.items()}
            yield PackedQueries(list(found), encoded, [p[:, 0] for p in pairs], [p[:, 1] for p in pairs])


def term_vectors(docs: DataFrame, queries: PackedQueries) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: all terms counted, those of the queries by number."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(queries.vocabulary))
    loaded: list = []

    def count(batch: pa.RecordBatch) -> dict:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        number = loaded[0].get
        sizes, ends, terms, tfs = [], [0], [], []
        for text in text_bytes(batch):
            words = ascii_terms(text)
            sizes.append(len(words))
            for word, n in Counter(words).items():
                term = number(word)
                if term is not None:
                    terms.append(term)
                    tfs.append(n)
            ends.append(len(terms))
        return {
            "doc_id": batch.column("doc_id"),
            "n": sizes,
            "terms": pa.ListArray.from_arrays(pa.array(ends, "i4"), pa.array(terms, "i4")),
            "tfs": pa.ListArray.from_arrays(pa.array(ends, "i4"), pa.array(tfs, "i4")),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(map_batches(rows, "doc_id long, n long, terms array<int>, tfs array<int>", count), "term_vectors")


def term_weights(vectors: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the weight of every query term."""
    n_docs, length = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
    df = np.zeros(terms, "i8")
    for r in held.collect():  # at most one row per query term
        df[r["term"]] = r["count"]
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    return n_docs, length, np.array(weights, "i8")


def impact_vectors(vectors: DataFrame, n_docs: int, length: int, weights: np.ndarray) -> DataFrame:
    """``(doc_id, norm, terms, impacts)``, every part longest first.

    The length is written beside the vector, so that the reader skips row groups whose
    longest vector can reach no query's k-th score.
    """
    weight = weights.astype("f8")

    def weigh(batch: pa.RecordBatch) -> dict:
        lists = batch.column("terms")
        ends = lists.offsets.to_numpy().astype("i8")
        terms, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype("i8")
        ends = ends - ends[0]
        m = np.array([75 + 25 * n * n_docs // length for n in batch.column("n").to_pylist()], "i8")
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(ends)))
        # each row on its own: a short vector must not lose its digits to the long ones before it
        squares = np.add.reduceat(weight[terms] * impact.astype("f8") ** 2, ends[:-1])
        return {
            "doc_id": batch.column("doc_id"),
            # sums of a few million squares: the slack covers their rounding
            "norm": np.sqrt(squares) * (1 + 1e-7) + 1e-3,
            "terms": pa.ListArray.from_arrays(pa.array(ends, "i4"), pa.array(terms, "i4")),
            "impacts": pa.ListArray.from_arrays(pa.array(ends, "i4"), pa.array(impact, "i4")),
        }

    held = vectors.where(F.size("terms") > 0)
    found = map_batches(held, "doc_id long, norm double, terms array<int>, impacts array<int>", weigh)
    return written(found.sortWithinPartitions(F.desc("norm")), "impact_vectors")


class Best:
    """The k best rows of every query so far: score, doc_id, and whether it has one."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows = [np.zeros((0, 3), "i8") for _ in range(queries)]

    def add(self, query: int, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows[query], rows])
        if len(rows) > self.k:
            rows = rows[np.lexsort((rows[:, 1], rows[:, 2], -rows[:, 0]))[: self.k]]
        self.rows[query] = rows
        if len(rows) == self.k:
            self.floor[query] = max(self.floor[query], rows[:, 0].min())


class Bucket:
    """Some vectors, longest first, by term: rows and impacts of every term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids, self.norms = ids, norms
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.impacts = impacts[order].astype("i8")
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(self.starts, len(terms))

    def postings(self, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the term, its rows, their impacts) of the terms present."""
        at = np.searchsorted(self.terms, terms)
        for i, a in enumerate(at.tolist()):
            if a < len(self.terms) and self.terms[a] == terms[i]:
                part = slice(self.starts[a], self.starts[a + 1])
                yield i, self.rows[part], self.impacts[part]


def search_bucket(bucket: Bucket, queries: PackedQueries, roots: np.ndarray, best: Best) -> None:
    reach = queries.norms * bucket.norms[0] * SLACK >= best.floor
    for q in np.flatnonzero(reach & (queries.norms > 0)).tolist():
        floor = best.floor[q]
        # rows whose length alone can reach the k-th score
        long = int(np.searchsorted(-bucket.norms, -floor / (queries.norms[q] * SLACK), "right"))
        product, square = np.zeros(len(bucket.norms)), np.zeros(len(bucket.norms))
        terms, values = queries.focus[q]
        for i, rows, impacts in bucket.postings(terms):
            x = roots[terms[i]] * impacts
            product[rows] += values[i] * x
            square[rows] += x * x
        left = np.sqrt(np.maximum(bucket.norms[:long] ** 2 - square[:long], 0.0))
        able = np.flatnonzero(product[:long] * SLACK + queries.rest[q] * left >= floor)
        if not len(able):
            continue
        score = np.zeros(len(bucket.norms), "i8")
        terms, factors = queries.terms[q], queries.factors[q]
        for i, rows, impacts in bucket.postings(terms):
            score[rows] += factors[i] * impacts
        able = able[score[able] >= max(floor, 1)]
        if len(able):
            best.add(q, np.column_stack([score[able], bucket.ids[able]]))


def search(vectors: DataFrame, queries: PackedQueries, floor: np.ndarray, k: int) -> DataFrame:
    """``(item_id, doc_id, score)``: the k best of every task that reach ``floor``.

    The vectors may come in any order; longest first lets whole buckets go.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((queries, floor)))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, least = pickle.loads(shared.value)
        packed = packed.prepared()
        roots = np.sqrt(packed.weights.astype("f8"))
        best = Best(len(packed.items), k, least)
        for batch in batches:
            # a batch may run over several parts, of which each is sorted by itself
            batch = batch.take(np.argsort(-batch.column("norm").to_numpy(), kind="stable"))
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = np.column_stack([batch.column("doc_id").fill_null(NO_ID).to_numpy(), missing]).astype("i8")
            norms = batch.column("norm").to_numpy()
            ends = batch.column("terms").offsets.to_numpy().astype("i8")
            terms = batch.column("terms").flatten().to_numpy()
            impacts = batch.column("impacts").flatten().to_numpy()
            ends = ends - ends[0]
            at = 0
            while at < len(norms):
                to = int(np.searchsorted(ends, ends[at] + BUCKET_NONZEROS, "right")) - 1
                to = min(max(to, at + 1), at + BUCKET_ROWS, len(norms))
                part = slice(ends[at], ends[to])
                bucket = Bucket(ids[at:to], norms[at:to], np.diff(ends[at : to + 1]), terms[part], impacts[part])
                search_bucket(bucket, packed, roots, best)
                at = to
        for item, rows in zip(packed.items, best.rows):
            if len(rows):
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_id": pa.array([item] * len(rows), pa.int64()),
                        "doc_id": pa.array(rows[:, 1], mask=rows[:, 2] == 1),
                        "score": rows[:, 0],
                    }
                )

    return vectors.mapInArrow(over, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best of ``docs(doc_id, text)`` per item.

    Items are ``(item_id, text)``. Only scores above 0 are ranked; equal scores by
    ascending doc_id, null last. Null texts hold no term; an item without a term, or whose
    terms no document holds, has no rows. Texts that share an item_id (null too) are one
    query, their terms added up. Rows that repeat a document are documents of their own.
    Without documents or items there are no rows. Extra columns are not looked at.
    """
    blocks = []
    for queries in packed_blocks(items, query_bytes):
        vectors = term_vectors(docs, queries)
        n_docs, length, queries.weights = term_weights(vectors, len(queries.vocabulary))
        if not length:
            continue
        impacts = impact_vectors(vectors, n_docs, length, queries.weights)
        cutoff = impacts.agg(F.percentile_approx("norm", 1.0 - SEED_SHARE)).first()[0]
        if cutoff is None:
            continue
        none = np.zeros(len(queries.items), "i8")
        first = written(_ranked(search(impacts.where(F.col("norm") >= cutoff), queries, none, k), k), "longest_found")
        full = first.where(F.col("rank") == k).select("item_id", "score").collect()  # a row per item of the block
        known = {r.item_id: r.score for r in full}
        floor = np.array([known.get(i, 0) for i in queries.items], "i8")
        lengths = PackedQueries.prepared(queries).norms
        reachable = float((floor[lengths > 0] / lengths[lengths > 0]).min() / SLACK) if (lengths > 0).any() else 0.0
        others = impacts.where((F.col("norm") < cutoff) & (F.col("norm") >= reachable))
        found = first.select("item_id", "doc_id", "score").unionByName(search(others, queries, floor, k))
        blocks.append(written(_ranked(found, k), "ranked"))
    if not blocks:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = blocks[0]
    for block in blocks[1:]:
        result = result.unionByName(block)
    return result.select("item_id", "rank", "doc_id", "score")
