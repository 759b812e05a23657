"""Exact top-k by integer inner product: branch and bound over a ball tree per shard.

Candidates are dealt into shards of bounded size; each shard is packed once with its ball
tree (centre, radius, range of points and children of every node) and written. Queries
come in blocks of bounded size and meet every shard. A block descends a shard's tree best
first: the next node is the one in which any of its open queries can reach the largest
inner product, and a query goes no deeper where its bound is below its k-th score. That
score starts from the first shard's results, is shared by all nodes of a shard, and is
handed on from shard to shard of a task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tollgate.session import BROADCAST_LIMIT_BYTES, written

SHARD_ROWS = 4_096
BLOCK_ROWS = 1_024
LEAF_ROWS = 64
# Sums of products up to here are exact in doubles; larger ones go through Python's integers.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def quantised(vector: str, scale: int = 256):
    """floor(scale * x) of every component x taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def ball_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """Order of the points; centre, radius, range in that order and children of every node.

    A node is halved at the median of its projection on the line through two far points;
    leaves have children -1, the root is node 0.
    """
    order, nodes, stack = np.arange(len(points)), [], [(0, len(points), None)]
    while stack:
        start, end, hook = stack.pop()
        members = order[start:end].copy()
        some = points[members]
        centre = some.mean(axis=0)
        distance = ((some - centre) ** 2).sum(axis=1)
        children = [-1, -1]
        if hook:
            parent, side = hook
            nodes[parent][4][side] = len(nodes)
        nodes.append((centre, np.sqrt(distance.max()), start, end, children))
        if end - start <= LEAF_ROWS:
            continue
        far = some[np.argmax(distance)]
        other = some[np.argmax(((some - far) ** 2).sum(axis=1))]
        order[start:end] = members[np.argsort(some @ (other - far), kind="stable")]
        half, me = (start + end) // 2, len(nodes) - 1
        stack += [(half, end, (me, 1)), (start, half, (me, 0))]
    centres, radii, starts, ends, children = (np.array(x) for x in zip(*nodes))
    return {"order": order, "centres": centres, "radii": radii, "starts": starts, "ends": ends, "children": children}


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return np.asarray(table.column("vector").combine_chunks().flatten(), "i8").reshape(-1, width)


def _pack_shard(rows: pa.Table) -> pa.Table:
    width, shard = rows.column("width")[0].as_py(), rows.column("shard")[0].as_py()
    ids = np.asarray(rows.column("vec_id"), "i8")
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], _matrix(rows, width)[by_id]
    packed = _packed(ids=ids, vectors=vectors, **ball_tree(vectors.astype("f8")))
    return pa.table({"width": [width], "shard": [shard], "tree": [packed]})


def _pack_block(rows: pa.Table) -> pa.Table:
    width, block = rows.column("width")[0].as_py(), rows.column("block")[0].as_py()
    floor = [-LONG - 1 if x is None else x for x in rows.column("floor").to_pylist()]
    packed = _packed(
        ids=np.asarray(rows.column("vec_id"), "i8"), query=np.asarray(rows.column("query"), "i8"),
        vectors=_matrix(rows, width), floor=np.asarray(floor, "i8"),
    )
    return pa.table({"width": [width], "block": [block], "queries": [packed]})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; beyond 64 bits the nearest long."""
    most = a.shape[1] * int(np.abs(a.astype("f8")).max(initial=0)) * int(np.abs(b.astype("f8")).max(initial=0))
    if most < EXACT:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    if most < LONG:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -LONG - 1, LONG).astype("i8")


def search_shard(
    queries: dict, shard: dict, k: int, floor: np.ndarray, seen: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of one shard for every query: query place, point place and score.

    ``floor`` are k-th scores known so far; it is raised in place. Ties go to smaller
    ids: points are numbered by id, and a node is only left out when it cannot tie.
    ``seen`` counts the (query, node) pairs opened, ``inner`` and ``leaf``.
    """
    points, vectors = shard["vectors"], queries["vectors"]
    first = np.searchsorted(shard["ids"], queries["ids"], "left")
    last = np.searchsorted(shard["ids"], queries["ids"], "right")
    exact = vectors.astype("f8")
    norms = np.sqrt((exact**2).sum(axis=1))
    best = np.full((len(vectors), k), -LONG - 1, "i8")
    place = np.full((len(vectors), k), len(points), "i8")

    def reach(some: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        bound = exact[some] @ shard["centres"][nodes].T + norms[some, None] * shard["radii"][nodes]
        return bound + 1e-6 * (1.0 + np.abs(bound))  # rounding of centres and radii may only keep more

    def look_at(members: np.ndarray, some: np.ndarray) -> None:
        score = products(vectors[some], points[members])
        itself = (members[None, :] >= first[some, None]) & (members[None, :] < last[some, None])
        score = np.where(itself, -LONG - 1, score)
        at = np.where(itself, len(points), np.broadcast_to(members, score.shape))
        score, at = np.hstack([best[some], score]), np.hstack([place[some], at])
        rank = np.lexsort((at, ~score), axis=1)[:, :k]  # ~ turns the order without overflow
        best[some], place[some] = np.take_along_axis(score, rank, 1), np.take_along_axis(at, rank, 1)
        floor[some] = np.maximum(floor[some], best[some, k - 1])

    everyone = np.arange(len(vectors))
    bound = reach(everyone, np.array([0]))[:, 0]
    heap = [(-bound.max(initial=-np.inf), 0, everyone, bound)]
    while heap:
        _, node, some, bound = heappop(heap)
        open_ = bound >= floor[some]
        some, bound = some[open_], bound[open_]
        if not len(some):
            continue
        children = shard["children"][node]
        if seen is not None:
            kind = "leaf" if children[0] < 0 else "inner"
            seen[kind] = seen.get(kind, 0) + len(some)
        if children[0] < 0:
            look_at(shard["order"][shard["starts"][node] : shard["ends"][node]], some)
            continue
        below = np.minimum(reach(some, children), bound[:, None])
        for side, child in enumerate(children):
            keep = below[:, side] >= floor[some]
            if keep.any():
                heappush(heap, (-below[keep, side].max(), int(child), some[keep], below[keep, side]))
    query, column = np.nonzero(place < len(points))
    return query, place[query, column], best[query, column]


def _search(k: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, dict] = {}
        at, shard = None, {}
        for batch in batches:
            names = ("width", "block", "shard", "queries", "tree")
            for width, block, number, packed, tree in zip(*(batch.column(c) for c in names)):
                key = (width.as_py(), block.as_py())
                if at != (width.as_py(), number.as_py()):  # a shard meets its blocks one after the other
                    at, shard = (width.as_py(), number.as_py()), _unpacked(tree.as_py())
                if key not in blocks:
                    blocks = {key: _unpacked(packed.as_py())} if len(blocks) > 8 else blocks | {key: _unpacked(packed.as_py())}
                queries = blocks[key]
                query, point, score = search_shard(queries, shard, k, queries["floor"])
                if len(query):
                    yield pa.RecordBatch.from_pydict(
                        {"query": queries["query"][query], "query_id": queries["ids"][query],
                         "vec_id": shard["ids"][point], "score": score}
                    )

    return over


def _meet(blocks: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Every block with every shard, some blocks at a time: those that fit a broadcast."""
    sizes = blocks.select("width", "block", F.length("queries").alias("bytes")).orderBy("width", "block").collect()
    groups, room = [[]], 0
    for row in sizes:  # one row per block of queries
        if room + row["bytes"] > BROADCAST_LIMIT_BYTES and groups[-1]:
            groups, room = [*groups, []], 0
        groups[-1].append((row["width"], row["block"]))
        room += row["bytes"]
    out = None
    for group in groups:
        by_width: dict[int, list[int]] = {}
        for width, block in group:  # blocks are numbered per width
            by_width.setdefault(width, []).append(block)
        parts = [(F.col("width") == width) & F.col("block").isin(some) for width, some in by_width.items()]
        some = F.broadcast(blocks.where(reduce(or_, parts, F.lit(False))))
        met = shards.join(some, "width").select("width", "block", "shard", "queries", "tree")
        found = met.mapInArrow(_search(k), "query long, query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest integer inner products of every query: rank, ``vec_id``, ``score``.

    Both sides have ``vec_id`` and an integer ``vector``. Candidates are all rows but
    those with the query's own ``vec_id``; with fewer than ``k`` all are returned. Ties
    go to the smaller ``vec_id``. Vectors of another length than the query's take no
    part, nor do null ones and rows without an id; queries that repeat each other are
    answered each. A product beyond 64 bits counts as the nearest long. No rows give no
    rows.
    """
    rows = vectors.where("vector is not null and vec_id is not null and size(vector) > 0")
    rows = rows.select("vec_id", "vector", F.size("vector").cast("long").alias("width"))
    # numbered, so that rows that repeat each other are dealt over the shards
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = rows.groupBy("width", "shard").applyInArrow(_pack_shard, "width long, shard long, tree binary")
    packed = written(packed, "ball_trees")
    asked = queries.where("vector is not null and vec_id is not null and size(vector) > 0")
    asked = asked.select("vec_id", "vector", F.size("vector").cast("long").alias("width"))
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))

    def pack(some: DataFrame, name: str) -> DataFrame:
        grouped = some.groupBy("width", "block")
        return written(grouped.applyInArrow(_pack_block, "width long, block long, queries binary"), name)

    seeds = pack(asked.withColumn("floor", F.lit(None).cast("long")), "query_blocks")
    first = packed.groupBy("width").agg(F.min("shard").alias("shard"))
    seeded = written(_best(_meet(seeds, packed.join(F.broadcast(first), ["width", "shard"]), k), k), "first_scores")
    floors = seeded.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    informed = pack(asked.join(floors, "query", "left"), "informed_blocks")
    others = packed.join(F.broadcast(first), ["width", "shard"], "left_anti")
    found = seeded.drop("rank").unionByName(_meet(informed, others, k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
