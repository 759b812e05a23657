"""Signature trees over token sets, and links between sets by dual traversal.

Sets are ordered by size and packed into leaves, leaves into nodes. Every node holds
the OR of its members' token bitmaps, their AND, and the range of their sizes. Two
nodes are compared by the largest overlap that any pair below them can reach: no more
than a set's size less the bits it has and the other node lacks. Pairs of nodes that
cannot reach the similarity, or whose members are one component already, are pruned.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
FAN_OUT = 4
# Bitmap words compared at once, so that memory does not follow the number of pairs.
PAIR_BLOCK_WORDS = 4_000_000


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` bits (a power of two) per set, as 64-bit words."""
    out = np.zeros((len(sets), bits // 64), "u8")
    sizes = [len(s) for s in sets]
    place = (np.concatenate(sets) & np.uint64(bits - 1)) if sets else np.zeros(0, "u8")
    rows = np.repeat(np.arange(len(sets)), sizes)
    flat = rows * (bits // 64) + (place >> np.uint64(6)).astype("i8")
    np.bitwise_or.at(out.reshape(-1), flat, np.uint64(1) << (place & np.uint64(63)))
    return out


def signature_bits(sizes: np.ndarray) -> int:
    """Bits that leave signatures of typical sets half empty."""
    typical = int(np.median(sizes)) if len(sizes) else 1
    return 1 << int(np.clip(np.ceil(np.log2(max(2 * typical, 1))), 8, 14))


class _Level:
    """Nodes of one level: members from ``start`` to ``stop`` in size order."""

    def __init__(self, start, stop, any_, all_, low, high):
        self.start, self.stop = start, stop
        self.any, self.all, self.low, self.high = any_, all_, low, high

    def up(self, fan_out: int) -> _Level:
        cut = np.arange(0, len(self.start), fan_out)
        last = np.minimum(cut + fan_out, len(self.start)) - 1
        return _Level(
            self.start[cut],
            self.stop[last],
            np.bitwise_or.reduceat(self.any, cut, axis=0),
            np.bitwise_and.reduceat(self.all, cut, axis=0),
            np.minimum.reduceat(self.low, cut),
            np.maximum.reduceat(self.high, cut),
        )


def _levels(bits: np.ndarray, sizes: np.ndarray) -> list[_Level]:
    """From the sets themselves up to one root."""
    at = np.arange(len(sizes))
    levels = [_Level(at, at + 1, bits, bits, sizes, sizes)]
    while len(levels[-1].start) > 1:
        levels.append(levels[-1].up(LEAF if len(levels) == 1 else FAN_OUT))
    return levels


def can_reach(a_any, a_all, a_low, a_high, b_any, b_all, b_low, b_high, similarity: int) -> np.ndarray:
    """Whether any pair below node pairs (row by row) can have the similarity in per cent."""
    most = np.minimum(
        a_high - np.bitwise_count(a_all & ~b_any).sum(axis=-1, dtype="i8"),
        b_high - np.bitwise_count(b_all & ~a_any).sum(axis=-1, dtype="i8"),
    )
    # 100 i >= s u and u = x + y - i: i (100 + s) >= s (x + y)
    return most * (100 + similarity) >= similarity * (a_low + b_low)


def _survivors(left: _Level, right: _Level, a, b, same_a, same_b, similarity) -> tuple[np.ndarray, np.ndarray]:
    keep_a, keep_b = [], []
    step = max(1, PAIR_BLOCK_WORDS // max(1, left.any.shape[1]))
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        open_ = (same_a[x] < 0) | (same_a[x] != same_b[y])
        x, y = x[open_], y[open_]
        fit = can_reach(
            left.any[x], left.all[x], left.low[x], left.high[x],
            right.any[y], right.all[y], right.low[y], right.high[y], similarity,
        )
        keep_a.append(x[fit])
        keep_b.append(y[fit])
    return np.concatenate([*keep_a, np.zeros(0, "i8")]), np.concatenate([*keep_b, np.zeros(0, "i8")])


def _uniform(level: _Level, component: np.ndarray) -> np.ndarray:
    """The component all members of a node share, or -1."""
    low = np.minimum.reduceat(component, level.start)
    return np.where(low == np.maximum.reduceat(component, level.start), low, -1)


def _children(at: np.ndarray, fan_out: int, count: int) -> np.ndarray:
    return np.minimum(at[:, None] * fan_out + np.arange(fan_out), count)


def candidate_pairs(a_sets, b_sets, a_component, b_component, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that survive the dual traversal; ``b_sets`` None: within ``a_sets``.

    Sets must be ordered by size.
    """
    itself = b_sets is None
    a_sizes = np.asarray([len(s) for s in a_sets], "i8")
    b_sizes = a_sizes if itself else np.asarray([len(s) for s in b_sets], "i8")
    width = signature_bits(np.concatenate([a_sizes, b_sizes]))
    left = _levels(bitmaps(a_sets, width), a_sizes)
    right = left if itself else _levels(bitmaps(b_sets, width), b_sizes)
    while len(left) < len(right):  # a lower tree waits at its root
        left.append(left[-1].up(FAN_OUT))
    while len(right) < len(left):
        right.append(right[-1].up(FAN_OUT))
    a, b = np.zeros(1, "i8"), np.zeros(1, "i8")
    for depth in range(len(left) - 1, -1, -1):
        x, y = left[depth], right[depth]
        if itself and depth == 0:
            a, b = a[a < b], b[a < b]
        a, b = _survivors(x, y, a, b, _uniform(x, a_component), _uniform(y, b_component), similarity)
        if depth:
            fan_out = LEAF if depth == 1 else FAN_OUT
            na, nb = len(left[depth - 1].start), len(right[depth - 1].start)
            wide_a = np.repeat(_children(a, fan_out, na), fan_out, axis=1).ravel()
            wide_b = np.tile(_children(b, fan_out, nb), (1, fan_out)).ravel()
            inside = (wide_a < na) & (wide_b < nb)
            if itself:
                inside &= wide_a <= wide_b
            a, b = wide_a[inside], wide_b[inside]
    return a, b


class _Overlaps:
    """Exact overlaps of one set with many, by postings of the many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.asarray([len(s) for s in sets], "i8")
        self.tokens = None

    def _index(self) -> None:
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.holders = flat[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]

    def all(self, one: np.ndarray) -> np.ndarray:
        if self.tokens is None:
            self._index()
        lo, hi = np.searchsorted(self.tokens, one, "left"), np.searchsorted(self.tokens, one, "right")
        lengths = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(self.holders[at], minlength=len(self.sets))

    def some(self, one: np.ndarray, places: np.ndarray) -> np.ndarray:
        if len(places) > 12:
            return self.all(one)[places]
        return np.asarray([len(np.intersect1d(one, self.sets[p], assume_unique=True)) for p in places], "i8")


def linked(one: int, sizes: np.ndarray, overlap: np.ndarray, similarity: int) -> np.ndarray:
    return overlap * 100 >= similarity * (one + sizes - overlap)


def links(
    a_sets: list[np.ndarray],
    b_sets: list[np.ndarray] | None,
    a_component: np.ndarray,
    b_component: np.ndarray | None,
    similarity: int,
) -> list[tuple[int, int]]:
    """Links that join components: ``(place in a, place in b)``.

    With ``b_sets`` None within ``a_sets``. Components are known equalities; a pair
    inside one is never tested, so the result is a spanning forest of the links, not
    all of them. Every pair between two components that could be linked is tested.
    """
    itself = b_sets is None
    if not len(a_sets) or (not itself and not len(b_sets)):
        return []
    order_a = np.argsort([len(s) for s in a_sets], kind="stable")
    a = [a_sets[i] for i in order_a]
    if itself:
        b, order_b = a, order_a
        names, known = np.unique(a_component[order_a], return_inverse=True)
        comp_a = comp_b = known.copy()
    else:
        order_b = np.argsort([len(s) for s in b_sets], kind="stable")
        b = [b_sets[i] for i in order_b]
        names, known = np.unique(np.concatenate([a_component[order_a], b_component[order_b]]), return_inverse=True)
        comp_a, comp_b = known[: len(a)].copy(), known[len(a) :].copy()
    other = _Overlaps(b)
    found: list[tuple[int, int]] = []

    def test(x: int, places: np.ndarray) -> None:
        places = places[comp_b[places] != comp_a[x]]
        if not len(places):
            return
        hit = places[linked(len(a[x]), other.sizes[places], other.some(a[x], places), similarity)]
        for y in hit:
            if comp_b[y] != comp_a[x]:
                found.append((int(order_a[x]), int(order_b[y])))
                old, new = comp_b[y], comp_a[x]
                comp_a[comp_a == old] = new
                if not itself:
                    comp_b[comp_b == old] = new

    if len(a) > LEAF:  # one set against all first: a group of near copies falls into one component
        test(len(a) // 2, np.arange(len(b)))
    at_a, at_b = candidate_pairs(a, None if itself else b, comp_a, comp_b, similarity)
    order = np.argsort(at_a, kind="stable")
    at_a, at_b = at_a[order], at_b[order]
    cuts = np.flatnonzero(np.diff(at_a)) + 1
    for places, x in zip(np.split(at_b, cuts), at_a[np.concatenate([[0], cuts]).astype("i8")] if len(at_a) else []):
        test(int(x), places)
    return found
