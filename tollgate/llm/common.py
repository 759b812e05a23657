"""Helpers shared by the operators: table reads, row keys, Arrow access, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.session import small_side, written

# White space and words of the contracts: bytes 0x20 and 0x09 to 0x0D part words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# Rows that a function of ``map_batches`` sees at once.
BATCH_ROWS = 512

# Terms of the contracts: runs of digits, letters and all that is not ASCII, A-Z lower-cased.
_TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(*columns: str):
    """A 64-bit key of a row's contents; rows that repeat each other share it."""
    return F.xxhash64(*columns)


def word_count(column: str):
    """Number of words of a text, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def map_batches(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` with a function from a batch to columns by name.

    The output columns may have any length. Spark's schema string fixes their types.
    Batches are cut, so that a worker's memory does not follow the batch.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                columns = make(batch.slice(at, BATCH_ROWS))
                if len(next(iter(columns.values()))):
                    yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(over, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty string."""
    return batch.column(column).fill_null("").to_pylist()


def ascii_terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: one pass over the bytes, no copy but the terms."""
    return text.translate(_TERM_BYTES).split()


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8, null as empty, not decoded."""
    return batch.column(column).cast(pa.large_binary()).fill_null(b"").to_pylist()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the least node.

    Every round each node's least smaller neighbour becomes its parent; its other
    smaller neighbours are linked to that parent, and the node itself to its
    grandparent. The rounds end when every node has one edge, to a node without one.
    They follow the logarithm of the longest path. Parents are counted and broadcast if
    they fit, else joined with both sides written, so that a hot parent can be split.
    Each round is written to the shared folder: a lost executor costs one round. No edge
    list leaves the executors. Nodes without an edge do not appear; loops and repeated
    edges are ignored; no edges, no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = written(pairs.distinct(), name)
    while True:
        parents = written(pairs.groupBy("a").agg(F.min("b").alias("m")), name)
        nodes, count = parents.count(), pairs.count()
        of = small_side(parents.select(F.col("a").alias("m"), F.col("m").alias("up")), nodes, 16)
        lifted = parents.join(of, "m", "left")
        if nodes == count and not lifted.where("up is not null").limit(1).count():
            break
        mine = small_side(parents, nodes, 16)
        others = pairs.join(mine, "a").where("b <> m")
        linked = others.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        jumped = lifted.select("a", F.coalesce("up", "m").alias("b"))
        pairs = written(linked.unionByName(jumped).distinct(), name)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Least member of each node's component, for edges between node numbers."""
    parent = np.arange(nodes)
    while len(a):
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return parent
