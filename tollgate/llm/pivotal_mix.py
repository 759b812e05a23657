"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

A source's target over its size is the number of copies its documents should have: a
whole part, which every document gets, and one fractional part. Fractions are rounded
by the pivotal method (Deville and Tille 1998): two documents meet, and a random
transfer of probability makes one of them whole; the other goes on. Documents of one size
class meet in blocks of bounded size, and what one gains in words the other loses; the one
left over of every block goes into blocks of the next round, a tree with one root per
class. The roots of a source are settled from the largest down, each with its own chance;
what a root gains or loses in words moves the chances of all smaller ones, by amounts
whose mean is zero. So every document keeps its chance, and a source stays at its target
up to a small document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollgate.llm.common import row_key, word_count
from tollgate.session import small_side, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
# Documents that meet one after the other within one row of the plan.
BLOCK = 64
# Size classes per doubling of the size; documents of one class meet first.
CLASSES = 8
SEED = 20
# Fractions nearer than this to a whole number are whole: sums of doubles leave dust.
DUST = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, documents, target)`` from ``sizes(source, size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum
    of all sizes. No target exceeds ``most`` times its source's size; the excess goes to
    the others by weight until none is above. With capacities sorted by capacity over
    weight, those are full whose capacity is below what the rest would give them; this
    needs one running sum over the sources (one row each), not a loop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    totals = written(totals, "source_sizes")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
    capacity = (most * F.col("source_size")).cast("double")
    by_fill = Window.orderBy(capacity / F.col("weight"), "weight", "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(after),
    ).withColumn("open", capacity >= F.col("level") * F.col("weight"))
    # the level of the first source that is not full holds for all later ones
    reached = level.withColumn("reached", F.min_by("level", F.when(F.col("open"), capacity / F.col("weight"))).over(everything))
    return reached.select(
        "source", "source_size", "documents",
        F.when(F.col("reached").isNull(), capacity)
        .otherwise(F.least(capacity, F.col("reached") * F.col("weight"))).alias("target"),
    )


def _draw(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _meet(left: Column, next_: Column) -> Column:
    """One step: the one left over meets the next document; ``taken`` gains who gets 1.

    Words of probability move between the two until one is whole: up to the left one or
    down to the next, each so far as it goes, with the chances that keep both means. The
    words that both stand for stay the same whichever way they move.
    """
    p, s, q, t = left["p"], left["size"], next_["p"], next_["size"]
    up, down = F.least((1.0 - p) * s, q * t), F.least(p * s, (1.0 - q) * t)
    rises = next_["draw"] * (up + down) < down
    new_p = F.when(rises, p + up / s).otherwise(p - down / s)
    new_q = F.when(rises, q - up / t).otherwise(q + down / t)
    left_whole = (new_p < DUST) | (new_p > 1.0 - DUST)
    whole, whole_p = F.when(left_whole, left["key"]).otherwise(next_["key"]), F.when(left_whole, new_p).otherwise(new_q)
    return F.struct(
        F.when(left_whole, next_["key"]).otherwise(left["key"]).alias("key"),
        F.when(left_whole, t).otherwise(s).alias("size"),
        F.greatest(F.least(F.when(left_whole, new_q).otherwise(new_p), F.lit(1.0)), F.lit(0.0)).alias("p"),
        F.when(whole_p > 0.5, F.concat(left["taken"], F.array(whole))).otherwise(left["taken"]).alias("taken"),
    )


NOBODY = "cast(array() as array<bigint>)"


def _blocks(open_: DataFrame, *block: Column) -> DataFrame:
    """Members of every block, largest first."""
    member = F.struct((-F.col("size")).alias("down"), "order", "key", "size", "p", "draw")
    return open_.groupBy("source", *block).agg(F.array_sort(F.collect_list(member)).alias("members"))


def _round(open_: DataFrame, *block: Column) -> DataFrame:
    """Let the members of every block meet: one row per block.

    ``taken`` are the keys of the documents that got 1; ``key``, ``size`` and ``p``
    belong to the one left over.
    """
    head = F.element_at("members", 1)
    start = F.struct(
        head["key"].alias("key"), head["size"].alias("size"), head["p"].alias("p"), F.expr(NOBODY).alias("taken")
    )
    rest = F.slice("members", F.lit(2), F.size("members"))
    met = _blocks(open_, *block).select("source", F.aggregate(rest, start, _meet).alias("end"))
    return met.select("source", "end.*")


def _settle(members: Column) -> Column:
    """Keys that get 1 of the members, largest first.

    Each is drawn with its own chance. The words that it then has too few or too many go to
    the smaller ones: their chances move in proportion to their distance from 0 or 1, as
    far as both outcomes allow, so that the mean of every move is zero.
    """

    def room(p: Column) -> Column:
        return F.least(p, 1.0 - p)

    def step(state: Column, i: Column) -> Column:
        me, p = F.element_at(members, i), F.element_at(state["ps"], i)
        one = me["draw"] < p
        words = F.when(one, p - 1.0).otherwise(p) * me["size"]
        able = F.aggregate(
            F.zip_with(F.slice(members, i + 1, F.size(members)), F.slice(state["ps"], i + 1, F.size(members)), lambda m, q: m["size"] * room(q)),
            F.lit(0.0), lambda total, x: total + x,
        )
        share = F.when(able > 0, F.least(F.lit(1.0), able / (F.greatest(p, 1.0 - p) * me["size"])) * words / able).otherwise(0.0)
        moved = F.transform(state["ps"], lambda q, j: F.when(j >= i, F.greatest(F.lit(0.0), F.least(F.lit(1.0), q + share * room(q)))).otherwise(q))
        return F.struct(moved.alias("ps"), F.when(one, F.concat(state["taken"], F.array(me["key"]))).otherwise(state["taken"]).alias("taken"))

    start = F.struct(F.transform(members, lambda m: m["p"]).alias("ps"), F.expr(NOBODY).alias("taken"))
    return F.aggregate(F.sequence(F.lit(1), F.size(members)), start, step)["taken"]


def _root(open_: DataFrame) -> DataFrame:
    """Keys that get 1 of the last left over of every class, by source: as many as classes."""
    return _blocks(open_).select(F.explode(_settle(F.col("members"))).alias("key"))


def size_class(size: str = "size") -> Column:
    return F.floor(F.log2(F.col(size)) * CLASSES)


def pivotal_copies(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Copies of ``docs(key, n, source, size)``, ``n`` rows alike under one unique key.

    Adds ``whole``, the copies that each of the rows gets, and ``more``, how many of them
    get one besides. A round leaves one document of every block, so the number of rounds
    follows the logarithm of the number of documents; one per size class and source is
    settled at the root.
    """
    rates = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    ).withColumn("whole", F.floor(F.col("rate") + DUST)).withColumn(
        "part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    )
    rates = written(rates, "rates")
    rates = small_side(rates, rates.count(), 64)
    rated = docs.join(rates, docs["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    # rows that repeat each other meet first: all but one become whole without a draw
    repeated = F.col("n") * F.col("part")
    rated = rated.withColumn("sure", F.floor(repeated + DUST))
    rated = written(rated.withColumn("p", F.greatest(repeated - F.col("sure"), F.lit(0.0))), "rated")
    open_ = rated.where((F.col("p") > DUST) & (F.col("size") > 0)).select("source", "size", "p", "key")
    open_ = open_.withColumn("order", F.xxhash64("key", F.lit(SEED + 1))).withColumn("draw", _draw("key"))
    # hot sources and classes are salted; a round leaves one document of every block
    left, taken, step = open_, None, 0
    while True:
        left = left.withColumn("band", size_class())
        bands = written(left.groupBy("source", "band").agg(F.count("*").alias("n")), "bands")
        # the sources' classes alone are looked at, not their documents
        if step and (bands.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        blocks = small_side(bands.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), bands.count(), 48)
        salted = left.alias("o").join(
            blocks.alias("b"),
            F.col("o.source").eqNullSafe(F.col("b.source")) & (F.col("o.band") == F.col("b.band")),
        ).select("o.*", F.pmod(F.xxhash64("key", F.lit(SEED + 2 + step)), F.col("blocks")).alias("salt"))
        done = written(_round(salted, F.col("band"), F.col("salt")), "pivotal")
        now = done.select(F.explode("taken").alias("key"))
        taken = now if taken is None else taken.unionByName(now)
        step += 1
        left = done.select("source", "size", "key", "p").withColumn("order", F.xxhash64("key", F.lit(SEED + 3 * step)))
        left = left.withColumn("draw", _draw("order", "key"))
    last = _root(left)
    extra = written(taken.unionByName(last).withColumn("extra", F.lit(1)), "extra_copies")
    return rated.join(extra, "key", "left").withColumn(
        "more", F.col("sure") + F.coalesce("extra", F.lit(0))
    )


def _counted(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, source, size, n)``: rows that repeat each other counted together."""
    sized = docs.select(
        row_key("doc_id", "source", "text").alias("key"), F.col("doc_id").cast("long"), "source",
        word_count("text").alias("size"),
    )
    return written(sized.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix of ``docs(doc_id, source, text)``, one row per group of rows alike.

    Returns ``key`` (of the row's contents), ``doc_id``, ``source``, ``size`` (words, 0
    for null), ``source_size``, ``target`` (of its source), ``n`` (rows alike), ``whole``
    and ``more``: every one of the n rows is taken ``whole`` times, ``more`` of them once
    more. Documents without words keep the whole part. A null source is a source of its
    own, after all others. Draws follow the row's contents, so reruns and other
    partitionings agree. No rows give no rows; extra columns are not looked at.
    """
    counted = _counted(docs)
    sizes = counted.select("source", (F.col("size") * F.col("n")).alias("size"))
    return pivotal_copies(counted, source_targets(sizes, weights, most))


def copies_by_row(mix: DataFrame) -> DataFrame:
    """One row per row of the documents, with its own ``copies``.

    Rows alike are spread out in two steps, so that no array grows with their number.
    """
    step = F.lit(4096)
    runs = mix.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))))
    size = F.least(step, F.col("n") - F.col("run") * step)
    rows = runs.withColumn("in_run", F.explode(F.sequence(F.lit(1), size.cast("int"))))
    rows = rows.withColumn("place", F.col("run") * step + F.col("in_run"))
    return rows.withColumn("copies", (F.col("whole") + (F.col("place") <= F.col("more")).cast("long")).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns unchanged.

    Of rows alike in doc_id, source and text one stands for all of them.
    """
    mix = mix_sources(docs, weights, most)
    copies = mix.select(F.col("key").alias("__row"), (F.col("n") * F.col("whole") + F.col("more")).alias("__copies"))
    copies = written(copies.where("__copies > 0"), "copies")
    rows = docs.withColumn("__row", row_key("doc_id", "source", "text"))
    rows = rows.join(small_side(copies, copies.count(), 24), "__row").dropDuplicates(["__row"])
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
