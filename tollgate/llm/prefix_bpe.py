"""Byte-level BPE by prefix dynamic programming, exact appends and edits included.

For every prefix of a byte string there is exactly one token that can come last in
the prefix's encoding. The state of a string is this array of last tokens: it is
filled from left to right, a candidate being valid when the pair it makes with the
last token of the prefix before it survives all merges. Appending to a string goes
on from its state; an edit refills from the place of the change until the old state
comes back. The encoding is read off the state from its end.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.llm.common import map_batches
from tollgate.llm.shingles import chunks, text_buffer

# Entries of a worker's caches before they are emptied, and the longest text that goes into
# them: together they bound their bytes. Results do not depend on them.
CACHE_ENTRIES = 300_000
CACHED_LENGTH = 64
# Libraries differ on whether 0x1C-0x1F are white space; Unicode says they are not.
SPACE = r"\p{White_Space}"
# The code points of that property, those within ASCII and the others in UTF-8.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WIDE_BLANKS = np.asarray([
    int.from_bytes(chr(c).encode())
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
])


def read_ranks(path: str) -> tuple[bytes, ...]:
    """Tokens of a rank file in rank order, read on the driver."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    return tuple(tokens[i] for i in range(len(tokens)))


class PrefixCodec:
    """Encoder and decoder for a vocabulary in rank order."""

    def __init__(self, tokens: tuple[bytes, ...], pattern: str):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self.valid: dict[int, bool] = {}  # by left token * number of tokens + right token
        self.longest = max(map(len, tokens))
        self.find = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.parts.append(self._parts(i, token))
            self.find.add_word(token.decode("latin-1"), (i, len(token)))
        self.find.make_automaton()
        self.valid.clear()  # filled while later merges were unknown
        inside = pattern.replace(r"[^\s", f"[^{SPACE}")
        self.pattern = regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.words = pa.array(tokens, pa.large_binary())
        self.digits = pa.array([f"{i} ".encode() for i in range(len(tokens))], pa.large_binary())
        self._pieces: dict[str, bytes] = {}
        self._units: dict[bytes, bytes] = {}

    def _parts(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; itself twice for a byte."""
        if len(token) == 1:
            return i, i
        for cut in range(1, len(token)):
            a, b = self.rank.get(token[:cut], i), self.rank.get(token[cut:], i)
            if a < i and b < i and self._stay_apart(a, b):
                self.merged[a, b] = i
                return a, b
        raise ValueError(f"token {i} cannot be reached by merges of lower rank")

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether neighbours ``a`` and ``b`` are left apart by every merge.

        Undo the later of the two last merges again and again: at no time may the
        tokens at the seam have been due to merge before what has been undone.
        """
        limit = len(self.tokens)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            first, second = self.parts[a][1], self.parts[b][0]
            if a > b and first != a or second == b:
                if first == a:
                    return True
                # undoing a on the left: a merge of equal rank at the seam would come later
                limit, a = a, first
            else:
                # undoing b on the right: the leftmost of equal merges goes first
                limit, b = b + 1, second

    def _learn(self, a: int, b: int) -> bool:
        if len(self.valid) > CACHE_ENTRIES:
            self.valid.clear()
        apart = self.valid[a * len(self.tokens) + b] = self._stay_apart(a, b)
        return apart

    def state(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Last token of every prefix of ``data``; goes on from ``last`` if given."""
        last = list(last or ())
        done, known, tokens = len(last), self.valid.get, len(self.tokens)
        start = max(0, done - self.longest)
        last += [-1] * (len(data) - done)
        for end, (token, size) in self.find.iter(data[start:].decode("latin-1")):
            end += start
            if end < done or last[end] >= 0:
                continue
            before = end - size
            if before >= 0:
                left = last[before]
                apart = known(left * tokens + token)
                if left < 0 or not (self._learn(left, token) if apart is None else apart):
                    continue
            last[end] = token
        return last

    def edited(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``data[start:end]``: the new bytes and their state.

        Positions before ``start`` keep their state. Behind the change the old state
        is taken over as soon as it has come back for as many positions as the longest
        token: whatever ends later then sees the same tokens before it.
        """
        changed = data[:start] + new + data[end:]
        state, same, shift = last[:start], 0, len(new) - (end - start)
        at = start
        while at < len(changed):
            upto = min(len(changed), at + 4 * self.longest)
            fresh = self.state(changed[:upto], state)
            for place in range(at, upto):
                old = place - shift
                same = same + 1 if old >= end and last[old] == fresh[place] else 0
                if same > self.longest:
                    return changed, fresh[: place + 1] + last[old + 1 :]
            state, at = fresh, upto
        return changed, state

    def read_off(self, last: list[int]) -> list[int]:
        """The encoding that a state stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        known = self.rank.get(data)
        return [known] if known is not None else self.read_off(self.state(data))

    def _unit(self, unit: bytes) -> bytes:
        """Ids of a stretch of text as packed 32-bit numbers, remembered if it is short."""
        ids = self._units.get(unit)
        if ids is None:
            ids = b"".join(map(self._piece, self.pattern.findall(unit.decode())))
            if len(unit) <= CACHED_LENGTH:
                if len(self._units) > CACHE_ENTRIES:
                    self._units.clear()
                self._units[unit] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = array("i", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= CACHED_LENGTH:
                if len(self._pieces) > CACHE_ENTRIES:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that ``offsets`` cut out of UTF-8 ``data``, and where each begins.

        A run of white space behind another character always begins a match of the
        pattern, whose look-ahead never sees past the character that ends the run. So
        texts are cut there, every distinct unit is encoded once, and the units' ids
        are put in the place of the units. Texts without white space go whole.
        """
        first = np.zeros(len(data), bool)
        first[unit_starts(data)] = True
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype("i8"))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)])
        coded = units.dictionary_encode()
        packed = [self._unit(unit) for unit in coded.dictionary.to_pylist()]
        ids = np.frombuffer(b"".join(packed), "i4")
        sizes = np.asarray([len(p) // 4 for p in packed], "i8")
        unit = coded.indices.to_numpy()
        begin = np.concatenate([[0], np.cumsum(sizes[unit])]).astype("i8")
        from_ = (np.cumsum(sizes) - sizes)[unit] if len(unit) else np.zeros(0, "i8")
        at = np.repeat(from_ - begin[:-1], sizes[unit]) + np.arange(begin[-1])
        return ids[at], begin[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> str:
        """Ids of a whole text in decimal, joined by single spaces."""
        data = np.frombuffer(text.encode(), "u1")
        return " ".join(map(str, self.encode_texts(data, np.asarray([0, len(data)]))[0]))

    def decode(self, ids: str) -> bytes:
        return self.spelled(np.fromstring(ids, "i4", sep=" "))[0].tobytes() if ids else b""

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, end to end, and where each id's begin."""
        return _laid_out(self.words, ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decimal digits of ids, a blank behind each, and where each id's begin."""
        return _laid_out(self.digits, ids)


def _laid_out(table: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taken = table.take(pa.array(at))
    _, offsets, data = taken.buffers()
    if data is None or not len(taken):
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    return np.frombuffer(data, "u1"), np.frombuffer(offsets, "i8")[: len(taken) + 1]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Places of ASCII white space behind a character that is none, in UTF-8 bytes.

    What lies before ``data`` does not count: its first byte begins no unit here.
    """
    blank = _BLANK[data]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    wide = at[data[at - 1] >= 0x80]
    if not len(wide):
        return at
    # the character before has several bytes: is it one of the wide kinds of white space?
    before = lambda n: data[np.maximum(wide - n, 0)].astype("u4")
    two, three = before(2) << 8 | before(1), before(3) << 16 | before(2) << 8 | before(1)
    return np.setdiff1d(at, wide[np.isin(two, _WIDE_BLANKS) | np.isin(three, _WIDE_BLANKS)], assume_unique=True)


@lru_cache(maxsize=2)
def _codec(tokens: tuple[bytes, ...], pattern: str) -> PrefixCodec:
    return PrefixCodec(tokens, pattern)


def _digest(data: np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def _encoded(codec: PrefixCodec, data: np.ndarray, offsets: np.ndarray, keep_ids: bool):
    """Numbers of ids, both digests and, if asked for, the ids of some texts."""
    ids, begin = codec.encode_texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    of_ids, of_bytes = [], []
    for digests, (letters, at), left in ((of_ids, codec.decimals(ids), 1), (of_bytes, codec.spelled(ids), 0)):
        for a, b in zip(at[begin[:-1]], at[begin[1:]]):
            digests.append(_digest(letters[a : max(a, b - left)]))
    return np.diff(begin), of_ids, of_bytes, ids if keep_ids else None


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and decode the ids again, one row per row.

    ``n_tokens``; ``ids_sha256``, the digest of the decimal ids joined by blanks;
    ``decoded_sha256``, that of the decoded bytes; with ``keep_ids`` also ``ids``.
    A null or empty text has no ids and the digests of nothing; a null ``doc_id``
    stays null; repeated rows give repeated rows; other columns are not looked at.
    One pass, no shuffle. The vocabulary is read on the driver and broadcast: its
    size is that of the file, whatever the corpus.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batch: pa.RecordBatch) -> dict:
        codec = _codec(shared.value, pattern)
        data, offsets = text_buffer(batch.column("text"))
        parts = [_encoded(codec, data, offsets[a : b + 1], keep_ids) for a, b in chunks(offsets)]
        n, of_ids, of_bytes, ids = zip(*parts)
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": np.concatenate(n),
            "ids_sha256": [x for part in of_ids for x in part],
            "decoded_sha256": [x for part in of_bytes for x in part],
        }
        if keep_ids:
            bounds = np.concatenate([[0], np.cumsum(out["n_tokens"])]).astype("i4")
            out["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, encode)
