"""Jaccard join of documents on word shingles, by classes, islands and signature trees.

1. Every text becomes its set of shingle hashes; equal sets make one class.
2. A class can only link when three quarters of its shingles (at 75 per cent) occur in
   other classes. Shingles go to buckets by hash, packed; each bucket tells which are
   shared, the counts are added up by class, and the other classes drop out.
3. The remaining sets meet on their prefixes (the least shingles of one global order,
   rare ones first): sets that link share one there. Connected meetings make islands,
   so that no link leaves an island. Sets of large islands meet again in the order of
   the exact number of sets that have a shingle, which parts what a passage had joined.
4. Islands are cut into tiles of bounded size. Signature trees find the links within
   tiles; tiles of one island are then compared with each other unless all their
   members are one component already.
5. Components of the links, by classes, give every document its component.

Nothing is sampled or capped. What is broadcast is counted first. Shuffles carry
packed numbers, and texts only of the classes that remain.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tollgate.llm.common import BATCH_ROWS, components, forest, map_batches, row_key
from tollgate.llm.shingles import chunks, mix, set_digests, shingle_sets, text_buffer
from tollgate.llm.signature_tree import links
from tollgate.session import drop_written, shuffle_partitions, small_side, written

# Text bytes per bucket of the shingle exchange, about as many shingles as fit a task. Every
# bucket names the classes it has shingles of, so fewer buckets move less.
BUCKET_BYTES = 32 * 1024 * 1024
# Shingles of a bucket that are compared at once.
BUCKET_RANGE = 2_000_000
# Sets compared within one task at a time.
TILE_SETS = 512
# A shingle in so many classes is told to the prefix order as frequent.
FREQUENT = 32
# Frequent shingles broadcast; with more, the bar is raised. Only the order follows them.
FREQUENT_ROWS = 1_000_000


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the narrowest type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _squeezed(values: np.ndarray) -> bytes:
    """An array's bytes, place by place, compressed; behind their number and width."""
    width, n = values.dtype.itemsize, len(values)
    if not n:
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view("u1").reshape(n, width).T)
    return n.to_bytes(4, "little") + bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _opened(data: bytes) -> np.ndarray:
    """The array that ``_squeezed`` took, unsigned."""
    if not data:
        return np.zeros(0, "u4")
    n, width = int.from_bytes(data[:4], "little"), data[4]
    planes = np.frombuffer(pa.decompress(data[5:], n * width, "zstd", asbytes=True), "u1").reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}")


def shingle_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``row``, ``doc_id``, ``n`` and the set's digest."""

    def digest(batch: pa.RecordBatch) -> dict:
        data, offsets = text_buffer(batch.column("text"))
        parts = [set_digests(shingle_sets(*_cut(data, offsets, a, b))) for a, b in chunks(offsets)]
        n, x, y = (np.concatenate(p) for p in zip(*parts))
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n": n, "class": x, "check": y}

    rows = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")
    return map_batches(rows, "row long, doc_id long, n long, class long, check long", digest)


def _cut(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, "i8")
    return starts, np.diff(np.append(starts, len(sorted_)))


def _by_bucket(buckets: np.ndarray):
    """Places per bucket of a sorted bucket column."""
    starts, lengths = _runs(buckets)
    for s, n in zip(starts, lengths):
        yield int(buckets[s]), slice(int(s), int(s + n))


def shared_counts(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """How many of a class's shingles other classes have, and which shingles are frequent.

    A shingle that several classes of one chunk have is counted there; the bucket gets
    a single entry for it, so a shingle of every document fills no task. The count may
    exceed the truth where copies of a class are met in several chunks, never fall below.
    """

    def pack(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in chunks(offsets):
                yield from _packets(shingle_sets(*_cut(data, offsets, a, b)), buckets)

    packets = docs.select("text").mapInArrow(
        pack, "bucket long, classes binary, own binary, who binary, hashes binary"
    )
    counted = packets.groupBy("bucket").applyInArrow(
        _count_shared(buckets), "part long, names binary, counts binary, shingle long, classes long"
    )
    counted = written(counted, "shared_shingles")
    parts = counted.where("part is not null").select("part", "names", "counts")
    per_class = parts.groupBy("part").applyInArrow(_add_counts, "class long, shared long")
    return per_class, counted.where("shingle is not null").select("shingle", "classes")


def _packets(sets: list[np.ndarray], buckets: int):
    """Batches of one row per bucket: shingles of a chunk, each with its class or a count."""
    sets = [s for s in sets if len(s)]
    if not sets:
        return
    _, digest, _ = set_digests(sets)
    names, first = np.unique(digest, return_index=True)
    sets = [sets[i] for i in first]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype="u4"), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    starts, lengths = _runs(flat)
    own = np.bincount(owner[np.repeat(lengths > 1, lengths)], minlength=len(sets)).astype("u4")
    hashes, alone, owner = flat[starts], lengths == 1, owner[starts]
    rows = {"bucket": [], "classes": [], "own": [], "who": [], "hashes": []}

    def add(bucket: int, classes, own: bytes, who: bytes, hashes: bytes) -> None:
        for column, value in zip(rows, (bucket, classes.astype("i8").tobytes(), own, who, hashes)):
            rows[column].append(value)

    for bucket, at in _by_bucket(_bucket(hashes, buckets)):
        low = (hashes[at] & np.uint64(0xFFFFFFFF)).astype("u4")
        order = np.argsort(low)
        low, one, whose = low[order], alone[at][order], owner[at][order]
        mine, place = np.unique(whose[one], return_inverse=True)
        who = 2 * lengths[at][order].astype("u4") + 1
        who[one] = 2 * place
        # shingles of one class that the bucket can't tell apart
        same = np.flatnonzero((low[1:] == low[:-1]) & one[1:] & one[:-1] & (whose[1:] == whose[:-1]))
        np.add.at(own, whose[same], np.uint32(1))
        add(bucket, names[mine], b"", _squeezed(_narrow(who)), _squeezed(np.diff(low, prepend=np.uint32(0))))
    # the chunk's own counts go to buckets picked by class, so that none gets those of all chunks
    counted = np.flatnonzero(own)
    target = _bucket(mix(names[counted].astype("i8").view("u8")), buckets)
    order = np.argsort(target, kind="stable")
    for bucket, at in _by_bucket(target[order]):
        mine = counted[order[at]]
        add(bucket, names[mine], _squeezed(_narrow(own[mine])), b"", b"")
    yield pa.RecordBatch.from_pydict(rows)


def _each(packets: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "i8") for x in packets.column(name).to_pylist()]


def _add_counts(packets: pa.Table) -> pa.Table:
    """Counts of all buckets added up by class."""
    names, place = np.unique(np.concatenate(_each(packets, "names")), return_inverse=True)
    counts = np.concatenate([_opened(x) for x in packets.column("counts").to_pylist()])
    counts = np.bincount(place, counts, len(names))
    return pa.table({"class": names, "shared": counts.astype("i8")})


def _count_shared(parts: int):
    """Task function on a bucket: how many of its classes' shingles here others have, packed
    by part of the classes, and the frequent shingles."""

    def over(packets: pa.Table) -> pa.Table:
        names, counts, shingles, classes_of = _shared_in_bucket(packets)
        bucket = packets.column("bucket")[0].as_py()
        rows = {"part": [], "names": [], "counts": [], "shingle": [], "classes": []}
        part = _bucket(names.view("u8"), parts)
        order = np.argsort(part, kind="stable")
        for number, at in _by_bucket(part[order]):
            here = order[at]
            for column, value in zip(rows, (number, names[here].tobytes(), _squeezed(_narrow(counts[here])), None, None)):
                rows[column].append(value)
        for shingle, n in zip(((np.uint64(bucket) << np.uint64(32)) | shingles).tolist(), classes_of.tolist()):
            for column, value in zip(rows, (None, None, None, shingle, n)):
                rows[column].append(value)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(rows.items(), kinds)})

    return over


def _shared_in_bucket(packets: pa.Table):
    """Classes with shared shingles and their number, frequent shingles and theirs.

    The bucket's shingles are compared range by range, so that memory does not follow them.
    """
    classes = _each(packets, "classes")
    names, number = np.unique(np.concatenate(classes), return_inverse=True)
    number = np.split(_narrow(number), np.cumsum([len(c) for c in classes])[:-1])
    counts = np.zeros(len(names), "i8")
    sorted_ = []
    for whose, own, who, hashes in zip(number, *(packets.column(c).to_pylist() for c in ("own", "who", "hashes"))):
        if own:
            np.add.at(counts, whose, _opened(own))
        if hashes:
            sorted_.append((np.cumsum(_opened(hashes), dtype="u4"), _opened(who), whose))
    total = sum(len(hashes) for hashes, _, _ in sorted_)
    bounds = np.linspace(0, 1 << 32, max(1, -(-total // BUCKET_RANGE)) + 1).astype("u8")
    often, classes_often = [np.zeros(0, "u4")], [np.zeros(0, "i8")]
    for low, high in zip(bounds[:-1], bounds[1:]):
        entries, told, numbers = [np.zeros(0, "u8")], [np.zeros(0, "u4")], [np.zeros(0, "i8")]
        for hashes, who, whose in sorted_:
            a, b = np.searchsorted(hashes, low), np.searchsorted(hashes, high)
            here, w = hashes[a:b], who[a:b]
            marked = (w & 1) == 1
            told.append(here[marked])
            numbers.append((w[marked] >> 1).astype("i8"))
            entries.append((here[~marked].astype("u8") << np.uint64(32)) | whose[w[~marked] >> 1])
        entries = np.unique(np.concatenate(entries))
        told, numbers = np.concatenate(told), np.concatenate(numbers)
        shingles, place = np.unique(np.concatenate([(entries >> np.uint64(32)).astype("u4"), told]), return_inverse=True)
        classes_of = np.bincount(place[: len(entries)], minlength=len(shingles))
        classes_of = classes_of + np.bincount(place[len(entries) :], numbers, minlength=len(shingles)).astype("i8")
        shared = classes_of[place[: len(entries)]] > 1
        counts += np.bincount((entries[shared] & np.uint64(0xFFFFFFFF)).astype("i8"), minlength=len(names))
        many = classes_of >= FREQUENT
        often.append(shingles[many])
        classes_often.append(classes_of[many])
    hit = np.flatnonzero(counts)
    return names[hit], counts[hit], np.concatenate(often).astype("u8"), np.concatenate(classes_often)


def _frequent(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their level, at most ``FREQUENT_ROWS``.

    A level counts doublings of the number of classes. Whole levels are left out from
    below until the rest is small enough to be sent to every task.
    """
    leveled = table.select("shingle", F.floor(F.log2("classes")).cast("int").alias("level"))
    sizes = sorted(leveled.groupBy("level").count().collect(), reverse=True)
    lowest, total = None, 0
    for level, count in sizes:
        total += count
        if total > FREQUENT_ROWS:
            break
        lowest = level
    if lowest is None:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    rows = leveled.where(F.col("level") >= lowest).toPandas()  # at most FREQUENT_ROWS
    order = np.argsort(rows["shingle"].to_numpy("i8").view("u8"))
    return rows["shingle"].to_numpy("i8").view("u8")[order], rows["level"].to_numpy("i8")[order]


def islands(sets: DataFrame, frequent, buckets: int, similarity: int) -> DataFrame:
    """``(class, island)`` of the sets that meet another on a prefix.

    All sets order their shingles alike: by level of frequency, then by hash. Two sets
    that link share one of the first ``n - needed + 1``, needed being the overlap that
    the larger set asks for alone.
    """
    known = sets.sparkSession.sparkContext.broadcast(frequent)

    def meet(batches):
        for batch in batches:
            names = np.asarray(batch.column("class"))
            flat, who = [], []
            for i, packed in enumerate(batch.column("hashes")):
                s = np.frombuffer(packed.as_buffer(), "u8")
                flat.append(_rare_first(s, known.value, buckets)[: _prefix(len(s), similarity)])
                who.append(np.full(len(flat[-1]), i))
            if flat:
                yield pa.RecordBatch.from_pydict(_meetings(names, np.concatenate(who), np.concatenate(flat), buckets))

    return _connected(sets.mapInArrow(meet, MEETINGS))


def _prefix(n, similarity: int):
    """So many of a set's least shingles have one of every set that links with it."""
    return n - -(-similarity * n // 100) + 1


MEETINGS = "bucket long, hashes binary, classes binary"


def _meetings(names: np.ndarray, holder: np.ndarray, hashes: np.ndarray, buckets: int) -> dict[str, list]:
    """Who of these sets meets whom, and by bucket the least of those that have a shingle."""
    order = np.lexsort((names[holder], hashes))
    hashes, holder = hashes[order], holder[order]
    starts, lengths = _runs(hashes)
    least = names[holder[starts]]
    pairs = np.stack(list(_stars(names[holder], np.repeat(least, lengths)).values()))
    rows = {"bucket": [-1], "hashes": [b""], "classes": [pairs.T.astype("i8").tobytes()]}
    hashes = hashes[starts]
    for bucket, at in _by_bucket(_bucket(hashes, buckets)):
        rows["bucket"].append(bucket)
        rows["hashes"].append(hashes[at].tobytes())
        rows["classes"].append(least[at].astype("i8").tobytes())
    return rows


def _connected(meetings: DataFrame) -> DataFrame:
    """``(class, island)`` of sets that meet, from rows of ``_meetings``."""

    def join(packets: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x, "u8") for x in packets.column("hashes").to_pylist()])
        classes = np.concatenate(_each(packets, "classes"))
        order = np.lexsort((classes, hashes))
        hashes, classes = hashes[order], classes[order]
        starts, lengths = _runs(hashes)
        return pa.table(_stars(classes, np.repeat(classes[starts], lengths)))

    def own(batch: pa.RecordBatch) -> dict:
        flat = np.concatenate([np.frombuffer(x, "i8") for x in batch.column("classes").to_pylist()]).reshape(-1, 2)
        return {"a": flat[:, 0], "b": flat[:, 1]}

    packets = written(meetings, "prefixes")
    across = packets.where("bucket >= 0").groupBy("bucket").applyInArrow(join, "a long, b long")
    within = map_batches(packets.where("bucket < 0").select("classes"), "a long, b long", own)
    found = components(across.unionByName(within), "islands")
    drop_written(packets)
    return found.select(F.col("node").alias("class"), F.col("root").alias("island"))


def finer_islands(sets: DataFrame, buckets: int, similarity: int) -> DataFrame:
    """``islands`` of ``sets(class, hashes)`` in the order of how many of them have a shingle.

    Chunks of sets tell each bucket their shingles and get back how many sets have them.
    """

    def tell(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                packed = part.column("hashes").to_pylist()
                hashes, counts = np.unique(np.frombuffer(b"".join(packed), "u8"), return_counts=True)
                sizes = np.asarray([len(x) // 8 for x in packed], "i8")
                rows = {"chunk": [], "bucket": [-1], "hashes": [b"".join(packed)], "counts": [sizes.tobytes()],
                        "classes": [np.asarray(part.column("class"), "i8").tobytes()]}
                for bucket, of in _by_bucket(_bucket(hashes, buckets)):
                    low = _squeezed((hashes[of] & np.uint64(0xFFFFFFFF)).astype("u4"))
                    for column, value in zip(list(rows)[1:], (bucket, low, _squeezed(_narrow(counts[of])), b"")):
                        rows[column].append(value)
                rows["chunk"] = [uuid.uuid4().bytes] * len(rows["bucket"])
                yield pa.RecordBatch.from_pydict(rows)

    def count(packets: pa.Table) -> pa.Table:
        hashes = [_opened(x) for x in packets.column("hashes").to_pylist()]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([_opened(x) for x in packets.column("counts").to_pylist()])
        level = _level(np.bincount(place, counts))[place]
        levels = np.split(level, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({"chunk": packets.column("chunk"), "bucket": packets.column("bucket"),
                         "hashes": pa.array([_squeezed(x) for x in levels], pa.binary()),
                         "counts": pa.nulls(len(levels), pa.binary()), "classes": pa.nulls(len(levels), pa.binary())})

    def meet(chunk: pa.Table) -> pa.Table:
        rows = chunk.sort_by("bucket").to_pydict()  # the sets are first
        hashes, sizes = np.frombuffer(rows["hashes"][0], "u8"), np.frombuffer(rows["counts"][0], "i8")
        level = np.concatenate([_opened(x) for x in rows["hashes"][1:]])
        holder = np.repeat(np.arange(len(sizes)), sizes)
        level = level[np.unique(hashes, return_inverse=True)[1]]
        order = np.lexsort((hashes, level, holder))
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[place < np.repeat(_prefix(sizes, similarity), sizes)]
        names = np.frombuffer(rows["classes"][0], "i8")
        return pa.table(_meetings(names, holder[order], hashes[order], buckets))

    kinds = "chunk binary, bucket long, hashes binary, counts binary, classes binary"
    told = written(sets.select("class", "hashes").mapInArrow(tell, kinds), "told_shingles")
    counted = told.where("bucket >= 0").groupBy("bucket").applyInArrow(count, kinds)
    again = told.where("bucket < 0").unionByName(counted)
    found = _connected(again.groupBy("chunk").applyInArrow(meet, MEETINGS))
    drop_written(told)
    return found


def _level(counts: np.ndarray) -> np.ndarray:
    """Numbers of sets in a byte: as they are up to 128, then by doublings."""
    high = 128 + 4 * np.log2(np.maximum(counts, 128) / 128)
    return np.where(counts < 128, counts, np.minimum(high, 255)).astype("u1")


def _rare_first(s: np.ndarray, frequent, buckets: int) -> np.ndarray:
    shingles, levels = frequent
    if not len(shingles):
        return s
    key = (_bucket(s, buckets).astype("u8") << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(shingles, key), len(shingles) - 1)
    level = np.where(shingles[at] == key, levels[at], 0)
    return s[np.lexsort((s, level))]


def _tile_links(similarity: int):
    """Task function: links within every tile of a work unit, or between the sides of a pair."""

    def over(unit: pa.Table) -> pa.Table:
        tile = np.asarray(unit.column("tile"))
        side = np.asarray(unit.column("side"))
        component, name = np.asarray(unit.column("component")), np.asarray(unit.column("class"))
        packed = unit.column("hashes").to_pylist()
        a, b = [], []
        order = np.argsort(tile, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            left, right = members[side[members] == 0], members[side[members] == 1]
            sets = lambda places: [np.frombuffer(packed[i], "u8") for i in places]
            if len(right):
                found = links(sets(left), sets(right), component[left], component[right], similarity)
            else:
                found, right = links(sets(left), None, component[left], None, similarity), left
            a += [name[left[i]] for i, _ in found]
            b += [name[right[j]] for _, j in found]
        return pa.table(_stars(np.asarray(a, "i8"), np.asarray(b, "i8")))

    return over


def _stars(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """The same components as those of the edges, every node linked to its least."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = names[forest(place[: len(a)], place[len(a) :], len(names))]
    apart = names != root
    return {"a": names[apart], "b": root[apart]}


def _link_tiles(work: DataFrame, unit: Column, similarity: int) -> DataFrame:
    return (
        work.select(unit.alias("unit"), "tile", "side", "component", "class", "hashes")
        .groupBy("unit")
        .applyInArrow(_tile_links(similarity), "a long, b long")
    )


def _small_islands(sets: DataFrame, of: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Links of the islands within ``TILE_SETS``, done whole, many to a task; and the sets of the larger ones."""
    sizes = of.groupBy("island").agg(F.count("*").alias("members"))
    total = of.count()
    placed = of.join(small_side(sizes, total, 24), "island")
    placed = sets.select("class", "n", "hashes").join(small_side(placed, total, 32), "class")
    placed = written(placed.withColumn("component", F.col("class")).withColumn("side", F.lit(0)), "placed")
    units = max(shuffle_partitions(sets.sparkSession), math.ceil(total / (4 * TILE_SETS)))
    small = placed.where(F.col("members") <= TILE_SETS).withColumn("tile", F.col("island"))
    found = written(_link_tiles(small, F.pmod(F.xxhash64("island"), F.lit(units)), similarity), "island_links")
    return found, placed.where(F.col("members") > TILE_SETS)


def island_links(sets: DataFrame, of: DataFrame, buckets: int, similarity: int) -> DataFrame:
    """Links that join the components of ``sets(class, n, hashes)``, as ``(a, b)``; drops ``sets``.

    ``of(class, island)`` says which sets can link. Islands within ``TILE_SETS`` are
    done whole, many to a task. Larger ones are parted by exact counts; what is still larger is dealt into tiles by size, first by
    themselves; what this has not joined is dealt anew by component, and tiles are
    compared pairwise where their sizes allow a link and they are not one component.
    """
    found, large = _small_islands(sets, of, similarity)
    drop_written(sets)
    if large.isEmpty():
        return found
    finer = written(finer_islands(large, buckets, similarity), "finer_islands")
    parted, left = _small_islands(large, finer, similarity)
    drop_written(large)
    found, large = found.unionByName(parted), left
    if large.isEmpty():
        return found
    total = finer.count()
    tiles = F.ceil(2 * F.col("members") / TILE_SETS)
    dealt = large.withColumn("tile", F.xxhash64("island", _salt(tiles)))
    first = written(_link_tiles(dealt, F.col("tile"), similarity), "tile_links")
    joined = components(first, "tile_components").select(F.col("node").alias("class"), "root")
    again = large.drop("component").join(small_side(joined, total, 24), "class", "left")
    again = again.withColumn("component", F.coalesce("root", "class")).drop("root")
    parts = again.groupBy("island", "component").agg(F.count("*").alias("part"))
    # members of a large component lie together, the others by size
    again = again.join(small_side(parts, total, 32), ["island", "component"])
    apart = F.when(F.col("part") >= TILE_SETS // 4, F.col("component"))
    again = again.withColumn("apart", apart).withColumn(
        "band", F.when(apart.isNull(), F.floor(F.log("n") / math.log(1.1)))
    )
    counts = again.groupBy("island", "apart", "band").agg(F.count("*").alias("together"))
    again = again.alias("m").join(
        small_side(counts, total, 40).alias("k"),
        (F.col("m.island") == F.col("k.island"))
        & F.col("m.apart").eqNullSafe(F.col("k.apart"))
        & F.col("m.band").eqNullSafe(F.col("k.band")),
    ).select("m.*", "k.together")
    again = written(
        again.withColumn("tile", F.xxhash64("island", "apart", "band", _salt(F.ceil(2 * F.col("together") / TILE_SETS))))
        .select("island", "class", "n", "component", "tile", "hashes"), "retiled")
    nodes = again.groupBy("island", "tile").agg(
        F.min("n").alias("low"), F.max("n").alias("high"),
        F.min("component").alias("least"), F.max("component").alias("most"),
    )
    nodes = written(nodes, "tile_nodes")
    x, y = nodes.alias("x"), nodes.alias("y")
    open_ = ~((F.col("x.least") == F.col("x.most")) & (F.col("y.least") == F.col("y.most"))
              & (F.col("x.least") == F.col("y.least")))
    near = (F.col("x.low") * similarity <= F.col("y.high") * 100) & (F.col("y.low") * similarity <= F.col("x.high") * 100)
    pairs = x.join(y, (F.col("x.island") == F.col("y.island")) & (F.col("x.tile") <= F.col("y.tile")) & near & open_)
    pairs = pairs.select(F.col("x.tile").alias("left"), F.col("y.tile").alias("right"))
    pairs = written(pairs.withColumn("pair", F.xxhash64("left", "right")), "tile_pairs")
    sides = pairs.select("pair", F.col("left").alias("tile"), F.lit(0).alias("side")).unionByName(
        pairs.where("left <> right").select("pair", F.col("right").alias("tile"), F.lit(1).alias("side"))
    )
    work = again.join(small_side(sides, 2 * pairs.count(), 24), "tile").drop("tile").withColumn("tile", F.col("pair"))
    second = _link_tiles(work, F.col("pair"), similarity)
    return found.unionByName(first).unionByName(second)


def _salt(tiles: Column) -> Column:
    return F.pmod(F.xxhash64("class", F.lit(7)), tiles)


def near_duplicates(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """Documents and their components under links of ``similarity`` per cent or more.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at. Returns one
    row per row: ``row`` (a key of its contents), ``doc_id``, ``n_shingles``,
    ``component_id``, the least ``doc_id`` reachable by links, and ``group``, a key of the
    component, null without shingles. Texts that are null,
    empty or blank have no shingles and link with nothing: their component is their own
    ``doc_id``. Copies have equal sets and are linked. A null ``doc_id`` is passed over
    as a component's name unless it is the only one. No rows give no rows.
    """
    digests = written(shingle_digests(docs), "digests")
    classes = digests.where("n > 0").groupBy("class", "check", "n").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("least")
    )
    classes = written(classes, "classes")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(shuffle_partitions(docs.sparkSession), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    buckets = max(least, math.ceil(size / BUCKET_BYTES))
    counts, frequent = shared_counts(docs, buckets)
    open_ = classes.join(counts, "class").where(F.col("shared") * 100 >= F.col("n") * similarity)
    open_ = written(open_.select("class", "row", "n"), "open_classes")
    sets = written(_sets(docs, open_), "sets")
    of = written(islands(sets, _frequent(frequent), buckets, similarity), "island_of")
    found = island_links(sets, of, buckets, similarity)
    joined = components(found, "document_links").select(F.col("node").alias("class"), "root")
    named = classes.join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # both sides written: a root of very many classes is broadcast to or split, not one task's
    named = written(named, "named_classes")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least_documents")
    of = written(named.join(small_side(least, least.count(), 16), "root").select("class", "check", "n", "root", "component_id"), "class_components")
    return digests.join(of, ["class", "check", "n"], "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("root").alias("group"),
    )


def _sets(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """``(class, n, hashes)`` of the classes that remain, from one document of each."""

    def pack(batch: pa.RecordBatch) -> dict:
        data, offsets = text_buffer(batch.column("text"))
        sets = [s for a, b in chunks(offsets) for s in shingle_sets(*_cut(data, offsets, a, b))]
        return {
            "class": batch.column("class"),
            "n": np.asarray([len(s) for s in sets], "i8"),
            "hashes": pa.array([s.tobytes() for s in sets], pa.binary()),
        }

    rows = docs.select(row_key("doc_id", "text").alias("row"), "text")
    one = rows.join(small_side(open_.select("row", "class"), open_.count(), 24), "row").dropDuplicates(["row"])
    return map_batches(one.select("class", "text"), "class long, n long, hashes binary", pack)


def keep_one_of_each(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """``docs`` with one row of every component: its least ``doc_id``, nulls last.

    Rows without shingles are all kept. Of rows that share the least ``doc_id`` the
    one with the least key stays. Columns of ``docs`` are unchanged, whatever their names.
    """
    found = near_duplicates(docs, similarity).where("n_shingles > 0")
    rows = found.groupBy("group", "doc_id", "row").agg(F.count("*").alias("rows"))
    chosen = rows.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"), F.col("rows"))).alias("first")
    )
    kept = chosen.groupBy(F.col("first.row").alias("__row")).agg((F.sum("first.rows") > 1).alias("__again"))
    kept = written(kept, "kept_rows")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(words).withColumn("__row", row_key("doc_id", "text"))
    rows = rows.join(small_side(kept, kept.count(), 16), "__row")
    out = rows.where(~F.col("__again")).select(docs.columns).unionByName(docs.where(~words))
    if kept.where("__again").isEmpty():
        return out
    # only texts of rows that repeat each other are shuffled
    again = rows.where("__again").dropDuplicates(["__row"])
    return out.unionByName(again.select(docs.columns))
