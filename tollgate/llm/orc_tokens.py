"""Token ids in ORC files: written in document order, read by stripe, pruned by id.

The file format is ORC: ids are integer columns (run-length encoded), every stripe
has row indexes, and a Bloom filter on ``doc_id`` lets readers skip row groups.
Part and offset columns make the place of every document known without a sort.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Encoding, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tollgate.llm.common import map_batches

# Words and ids that a worker's cache may hold before only the frequent ones are kept, and
# the longest word that it keeps; results do not depend on them.
CACHE_ENTRIES = 200_000
CACHE_IDS = 2_000_000
CACHED_LENGTH = 64
# Texts and bytes that are encoded at once, and bytes that are cut into pieces at once.
BATCH_TEXTS = 4_000
BATCH_BYTES = 8_000_000
CUT_BYTES = 500_000
# Words that are given to the tokenizer as one text, and words of letters to its model.
JOINED = 256
LETTERS_JOINED = 2_048
# Texts of joined words whose encodings are held at once.
AT_ONCE = 16
STRIPE_BYTES = 16 * 1024 * 1024
# Rows of a row group, the unit that row indexes and Bloom filters prune.
INDEX_ROWS = 1_000
FILES = "part int, first long, doc_id long, size int, ids array<int>"


# Letters beyond Latin, and the dotted capital I: their lower case may hang on what stands around.
_ODD = re.compile(r"[^\x00-\u012f\u0131-\u024f]")


# Marks of ASCII, which make pieces of their own; the apostrophe joins what stands behind it.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")

# Kinds of bytes: blanks part words, letters and marks make pieces within a word, a word with any
# other byte stays whole. Letters that are not ASCII are two bytes, U+00C0 to U+023F but for three.
BLANK, LETTER, MARK, OTHER, SPECIAL = range(5)
NO_LETTERS = [c.encode() for c in "×÷\u0130"]
NO_LETTER = "[^A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u023f]"


def _kind(byte: int) -> int:
    if byte in b" \n":
        return BLANK
    if 0xC3 <= byte <= 0xC8 or 0x80 <= byte <= 0xBF or byte < 0x80 and chr(byte).isalpha():
        return LETTER
    return MARK if chr(byte) in MARKS else OTHER


KINDS = bytes(map(_kind, range(256)))
WHOLE = bytes(BLANK if k == BLANK else OTHER for k in KINDS)
LOWER = bytes(range(256)).lower()
ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])


def _letters(word: str) -> bool:
    """Whether all are Latin letters."""
    return word.isalpha() and (word.isascii() or not _ODD.search(word))


def _places(starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The places, below ``most``, of runs that begin at ``starts``, one run after the other."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    narrow = "i4" if max(total, most) < 1 << 31 else "i8"
    place = np.repeat((starts - (upto - sizes)).astype(narrow), sizes)
    place += np.arange(total, dtype=narrow)
    return place


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    return flat[_places(starts, sizes, len(flat))]


def _found(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class WordCache:
    """Encodes texts with a tokenizer that drops white space, piece by piece.

    Blanks and line feeds part tokens in such a tokenizer whatever stands around them, so
    the ids of a text are those of its words in a row. Where the tokenizer parts letters and
    marks too, words of Latin letters and marks of ASCII are cut between the two, and capitals
    of ASCII are made small if it does so itself; other words stay as they are, but for marks
    at their end. Pieces are cut by numpy and numbered by Arrow; each that is not in the worker's
    cache is given to the tokenizer once a batch, many joined by a special token; those of Latin
    letters alone, which it neither changes nor parts, go to its model joined by blanks. Whether all this holds is
    tried out at the start.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        if self._ids("a b\nc") != self._ids("a") + self._ids("b") + self._ids("c"):
            raise ValueError("this tokenizer keeps white space: it cannot be used word by word")
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        self.specials = [t.content.encode() for t in added.values()]
        plain = [(i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.joint = plain[0] if plain else (None, None)
        self.lowers = all(self._ids(w) == self._ids(w.lower()) for w in ("AbC", "ÀÉÎ", "ÇŁŽ", "X1Y"))
        self.parts = len(plain) == len(added) and all(
            self._ids(w + s + v) == self._ids(w) + self._ids(s) + self._ids(v)
            for w, v in (("ab", ""), ("Q", "Q"), ("é", "é"), ("7", ""), ("x1", ""), ("", "ab"), ("s", "s"))
            for s in (*MARKS, "###", ".,!?")
        )
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and not _ODD.search(c)]
        tried = {c.lower() for c in letters} | {(a + b + "ab").lower() for a, b in zip(letters, letters[7:])} | {"words", "naïveté"}
        self.bare = self.lowers and all(self._model_ids(w) == self._ids(w) for w in sorted(tried))
        # tokens that end a word, for models that mark them, tell where the words of a text end
        self.ends = None
        if suffix := getattr(self.model, "end_of_word_suffix", None):
            tokens = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(tokens.values()) + 1, bool)
            self.ends[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
            # every word comes once: a cache within the model would only cost time
            rules = json.loads(spec)["model"] | {"cache_capacity": 0}
            rules["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in rules["merges"]]
            self.letters = Tokenizer(BPE(**{k: v for k, v in rules.items() if k != "type" and v is not None}))
            self.letters.pre_tokenizer = CharDelimiterSplit(" ")
            self.bare = self.bare and self._by_model(sorted(tried))[0].tolist() == list(chain.from_iterable(map(self._ids, sorted(tried))))
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model_ids(self, word: str) -> list[int]:
        """Ids of a word that is one piece for the tokenizer, as bytes for its model."""
        if not (word.isascii() and word.isalnum()):
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(word)]

    def _clear(self) -> None:
        self.words, self.flat, self.starts = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, "i8")
        self.again = np.zeros(0, bool)  # words met in a later batch

    @property
    def number(self) -> dict[str, int]:
        """The cached words and their numbers."""
        return {word: i for i, word in enumerate(self.words.to_pylist())}

    def _encodings(self, texts: list[str]) -> Iterator[Encoding]:
        """Encodings hold far more than ids: only some texts' are kept at a time."""
        for at in range(0, len(texts), AT_ONCE):
            yield from self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_tokenized``, for words of Latin letters alone."""
        ids, sizes = [], []
        for at in range(0, len(words), LETTERS_JOINED):
            some = words[at : at + LETTERS_JOINED]
            ends = ()
            if self.ends is not None:
                text = " ".join(some).lower()
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(BYTE_LETTERS | {0x20: " "})
                (done,) = self.letters.encode_batch_fast([text], add_special_tokens=False)
                found = np.array(done.ids, "<u4")
                ends = np.flatnonzero(self.ends[found])
            if len(ends) == len(some):
                sizes.append(np.diff(ends, prepend=-1))
            else:
                lists = [self._model_ids(w.lower()) for w in some]
                found = np.fromiter(chain.from_iterable(lists), "<u4")
                sizes.append(np.array([len(x) for x in lists], "i8"))
            ids.append(found)
        return np.concatenate(ids), np.concatenate(sizes)

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if self.bare and _letters("".join(words)):
            return self._by_model(words)
        if self.mark is None:
            found = [e.ids for e in self._encodings(words)]
            return np.fromiter(chain.from_iterable(found), "<u4"), np.array([len(x) for x in found], "i8")
        texts = [self.joint.join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        ids, sizes = [], []
        for done in self._encodings(texts):
            found = np.array(done.ids, "<u4")
            marks = np.flatnonzero(found == self.mark)
            ids.append(np.delete(found, marks))
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words in the order they are given to the tokenizer, ids in a row, how many each has."""
        odd = pc.match_substring_regex(words, NO_LETTER).to_numpy(zero_copy_only=False) | (not self.bare)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        special = np.fromiter(map(bool, map(self.special.search, words.take(rest).to_pylist())), bool, len(rest))
        # ids in one row: a list kept for every word is what the collector goes through again and again
        found = [self._ids(word) for word in words.take(rest[special]).to_pylist()]
        ids, sizes = [np.fromiter(chain.from_iterable(found), "<u4")], [np.array([len(x) for x in found], "i8")]
        for some in (plain, rest[~special]):
            if len(some):
                more, more_sizes = self._tokenized(words.take(some).to_numpy(zero_copy_only=False).tolist())
                ids.append(more)
                sizes.append(more_sizes)
        return np.concatenate([rest[special], plain, rest[~special]]), np.concatenate(ids), np.concatenate(sizes)

    def _keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def _thin(self) -> None:
        """Keep the words met again, which are the frequent ones, unless they fill the cache."""
        frequent = np.flatnonzero(self.again)
        words, size = self.words.take(frequent), np.diff(self.starts)[frequent]
        ids = _gathered(self.flat, self.starts[frequent], size)
        self._clear()
        if len(words) <= CACHE_ENTRIES // 2 and len(ids) <= CACHE_IDS // 2:
            self._keep(words, ids, size)

    def _pieces(self, data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of texts in a row, and the number of pieces up to each text's end."""
        raw, kinds = np.frombuffer(data, "u1"), np.frombuffer(data.translate(KINDS if self.parts else WHOLE), "u1")
        # runs of bytes of one kind within a text
        new = np.ones(len(raw) + 1, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=new[1:-1])
        new[offsets] = True
        cut = np.flatnonzero(new).astype("i4")
        at = np.searchsorted(cut, offsets)
        sizes, cut = np.diff(cut), cut[:-1]
        kind = kinds[cut]
        opens = np.zeros(len(cut) + 1, bool)
        opens[at] = True
        blank = np.append(kind == BLANK, True)
        keep = ~blank[:-1]
        head = keep & (opens[:-1] | np.roll(blank, 1)[:-1])
        for parts, what in ((NO_LETTERS, OTHER), (self.specials, SPECIAL)):
            for place in chain.from_iterable(_found(data, part) for part in parts):
                kind[np.searchsorted(cut, place, "right") - 1] = what
        packed = np.frombuffer(data.translate(LOWER if self.lowers and self.parts else None, b" \n"), "u1")
        sizes[blank[:-1]] = 0
        starts = np.cumsum(sizes, dtype="i4") - sizes
        if (kind >= OTHER).any():
            # words that stay whole, as they are; marks at their end go
            word = np.cumsum(head, dtype="i4") - 1
            whole, special = np.zeros(word[-1] + 1, bool), np.zeros(word[-1] + 1, bool)
            whole[word[kind >= OTHER]] = True
            special[word[kind == SPECIAL]] = True
            inside = keep & whole[word]
            last = np.flatnonzero(inside & ~head & (kind == MARK) & (blank | opens)[1:] & ~special[word])
            keep &= ~inside | head
            keep[last[ALNUM[raw[cut[last] - 1]]]] = True
            place = _places(starts[inside], sizes[inside], len(packed))
            packed = packed.copy()
            packed[place] = np.frombuffer(data.translate(None, b" \n"), "u1")[place]
        starts = np.append(starts[keep], np.int32(len(packed)))
        pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(packed))
        return pieces, np.concatenate([[0], np.cumsum(keep)])[at]

    def _numbered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces not in the cache; the numbers of all pieces in a row, behind the cache's
        where they are new; how many pieces there are up to each text's end."""
        texts = texts.cast(pa.string())
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], "i4")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i4")
        found, ends, at = [], [np.zeros(1, "i8")], 0
        while at < len(texts):
            to = max(int(np.searchsorted(offsets, offsets[at] + CUT_BYTES, "right")) - 1, at + 1)
            some = offsets[at : to + 1]
            data = buffers[2].slice(int(some[0]), int(some[-1] - some[0])).to_pybytes() if buffers[2] else b""
            pieces, upto = self._pieces(data, some - some[0])
            found.append(pieces)
            ends.append(ends[-1][-1] + upto[1:])
            at = to
        # Arrow numbers words as they come: with the cache first, its words keep their numbers
        known = len(self.words)
        words = pa.chunked_array([self.words, *found], pa.string()).combine_chunks().dictionary_encode()
        return words.dictionary.slice(known), words.indices.to_numpy()[known:], np.concatenate(ends)

    def encode(self, texts: pa.Array, end: list[int] = []) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end``, and how many each has."""
        if len(self.words) > CACHE_ENTRIES or len(self.flat) > CACHE_IDS:
            self._thin()
        fresh, row, ends = self._numbered(texts)
        known = len(self.words)
        self.again[row[row < known]] = True
        order, ids, sizes = self._learn(fresh)
        pool, start, size = np.concatenate([self.flat, ids]), np.zeros(known + len(fresh), "i8"), np.zeros(known + len(fresh), "i8")
        start[:known], size[:known] = self.starts[:-1], np.diff(self.starts)
        start[known + order], size[known + order] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        fresh = fresh.take(order)
        short = pc.less_equal(pc.utf8_length(fresh), CACHED_LENGTH).to_numpy(zero_copy_only=False)
        self._keep(fresh.filter(short), ids[np.repeat(short, sizes)], sizes[short])
        # the end of a text is one more piece
        pool, start, size = np.append(pool, np.array(end, "<u4")), np.append(start, len(pool)), np.append(size, len(end))
        each = np.insert(row, ends[1:], len(size) - 1)
        del row
        # a batch's ids are few enough for narrow numbers, of which there are several per piece
        narrow = "i4" if len(pool) < 1 << 31 else "i8"
        lengths = size.astype(narrow)[each]
        upto = np.cumsum(lengths, dtype="i8")
        upto = np.concatenate([[0], upto])[ends + np.arange(len(ends))]
        return _gathered(pool, start.astype(narrow)[each], lengths), np.diff(upto)


@lru_cache(maxsize=2)
def _cache(spec: str) -> WordCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks keep the cores busy
    return WordCache(spec)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Write the token ids of ``docs(doc_id, text)`` as ORC below ``path``.

    Documents lie in ascending ``doc_id`` order, nulls first, over the files in the
    order of their ``part``; rows that share a ``doc_id`` are ordered by a key of
    their text, so that a hot id can be spread. Every document ends in ``end_id``; a
    null or empty text has no other id. Rows: ``part``, ``first`` (ids before it in
    its part), ``doc_id``, ``size`` (number of ids), ``ids``. Extra columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:  # a fixed file, whatever the corpus
        shared = spark.sparkContext.broadcast(file.read())

    def encode() -> Callable[[pa.RecordBatch], dict]:
        before = 0

        def one(batch: pa.RecordBatch) -> dict:
            nonlocal before
            flat, sizes = _cache(shared.value).encode(batch.column("text").fill_null(""), [end_id])
            ends = np.cumsum(sizes)
            first, before = before + ends - sizes, before + int(ends[-1])
            offsets = np.concatenate([[0], ends]).astype("i4")
            return {
                "part": batch.column("part"),
                "first": first,
                "doc_id": batch.column("doc_id"),
                "size": sizes.astype("i4"),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view("<i4"))),
            }

        return one

    def over(batches):
        one = encode()  # counts anew in every part
        for batch in batches:
            bytes_ = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype="i8")])
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(bytes_, bytes_[at] + BATCH_BYTES, "right")) - 1
                to = min(max(to, at + 1), at + BATCH_TEXTS)
                yield pa.RecordBatch.from_pydict(one(batch.slice(at, to - at)))
                at = to

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    (
        ordered.mapInArrow(over, FILES)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.stripe.size", STRIPE_BYTES)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as ``(start, doc_id, ids)``; start counts the ids of all documents before.

    Totals per part are one row each, from columns beside the ids, so the running sum over them is as small as
    the number of files; it is joined back without a shuffle of the ids.
    """
    rows = spark.read.schema(FILES).orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("first") + F.col("size")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        (F.col("offset") + F.col("first")).alias("start"), "doc_id", "ids"
    )


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; Spark hands the ids to ORC, which skips stripes and row groups."""
    rows = spark.read.schema(FILES).orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_checksums(tokens: DataFrame) -> DataFrame:
    """Per document ``n_tokens`` and the unsigned crc32 of its ids as 4-byte little-endian."""

    def check(batch: pa.RecordBatch) -> dict:
        ids = batch.column("ids")
        offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values, dtype="<u4")
        return {
            "doc_id": batch.column("doc_id"),
            "start": batch.column("start"),
            "n_tokens": np.diff(offsets).astype("i8"),
            "ids_crc32": np.asarray(
                [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], "i8"
            ),
        }

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return map_batches(tokens.select("doc_id", "start", "ids"), schema, check)
