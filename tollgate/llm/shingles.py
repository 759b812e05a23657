"""Distinct word shingles of whole texts as 64-bit hashes, worked out on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
# Bytes of text hashed at once, so that memory does not follow the batch; a longer text goes whole.
CHUNK_BYTES = 2 * 1024 * 1024


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (Steele et al. 2014): a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit factors."""
    return mix(np.arange(1, n + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = _draws(256, 1)[_LOWER]  # A-Z count as a-z
_PLACE = _draws(WORDS, 2)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as the empty string."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about ``CHUNK_BYTES`` each."""
    out, first = [], 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[first] >= CHUNK_BYTES or i == len(offsets) - 1:
            out.append((first, i))
            first = i
    return out


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (and after the last)."""
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    opens[cuts] = inside[cuts]
    letters = np.flatnonzero(inside)
    first = np.flatnonzero(opens[letters])  # of each word, among the letters
    if not len(first):
        return np.zeros(0, "u8"), np.zeros(len(offsets), "i8")
    sizes = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    factors = _draws(int(sizes.max()), 3)
    sums = np.add.reduceat(_BYTE[data[letters]] * factors[place], first)
    words = mix(sums + sizes.astype("u8") * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(letters[first], offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    A text of one to four words has its whole word sequence as the one shingle; a
    text without words has none. Equal sets of hashes stand for equal sets of
    shingles up to collisions of 64-bit hashes.
    """
    words, before = _word_hashes(data, offsets)
    runs = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(runs, "u8")
    for k in range(WORDS):
        rolled += mix(words[k : k + runs] ^ _PLACE[k]) * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = mix(words[a:b] ^ _PLACE[: b - a]) * _PLACE[: b - a]
            out.append(mix(short.sum(dtype="u8", keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent 64-bit sums of every set."""
    sizes = np.asarray([len(s) for s in sets], "i8")
    sums = []
    for salt in (0x8CB92BA72F3D8DD7, 0xAAAAD2B1F0C53A19):
        sums.append(np.asarray([mix(s ^ np.uint64(salt)).sum(dtype="u8") for s in sets], "u8").view("i8"))
    return sizes, sums[0], sums[1]
