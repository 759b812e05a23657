"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton enumerates the pieces that end at every place; the dynamic
program carries the best score and the number of pieces, no back pointers. Ties follow
the tokenizer: of equal scores the longest piece wins, and a character without a piece
of its own may be unknown at the least score less a penalty. Unknown characters become
one piece per byte where the vocabulary has all bytes, else one per run.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from tollgate.llm.common import map_batches, texts

# Entries of a worker's cache before it is emptied, and the longest unit that goes into it:
# together they bound its bytes. Results do not depend on them.
CACHE_ENTRIES = 1_000_000
CACHED_LENGTH = 64
BLANK = "▁"
# Fixed value: what an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a model file, in the order of their ids; read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class UnigramCounter:
    """Counts the pieces of the best segmentation of a text."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...]):
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.pieces = {}
        for piece, score in vocabulary:
            if piece:
                self.pieces[piece] = score
        self.bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.find = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        # a line feed that no piece holds is unknown wherever it stands: units end there
        self.cut = self.bytes and not any("\n" in piece for piece in self.pieces)
        self.known: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Pieces of a text without looking at white space."""
        if text in self.pieces and len(text) == 1:
            return 1
        n = len(text)
        # plain numbers, 17 bytes a character, for units of any length
        score, count, lost = array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8)), bytearray(n + 1)
        matches = self.find.iter(text)  # in order of their ends
        end_at, found = next(matches, (n, None))
        for end in range(1, n + 1):
            best, at = None, 0
            single = False
            while end_at < end:  # longest first
                size, value = found
                end_at, found = next(matches, (n, None))
                total = score[end - size] + value
                if best is None or total > best:
                    best, at = total, end - size
                single = single or size == 1
            unknown = False
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, at, unknown = total, end - 1, True
            score[end] = best
            lost[end] = unknown
            if not unknown:
                count[end] = count[at] + 1
            elif self.bytes:
                count[end] = count[at] + len(text[at].encode())
            else:
                count[end] = count[at] + (not lost[at])
        return count[n]

    def __call__(self, text: str) -> int:
        """Pieces of a whole text: blanks begin units and are part of their pieces."""
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        units = text.split(BLANK)
        units = units if text.startswith(BLANK) else ["", *units]
        return sum(map(self._blank_unit, units[1:]))

    def _blank_unit(self, unit: str) -> int:
        found = self.known.get(unit)
        if found is None:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            if self.cut and "\n" in unit:
                first, *rest = unit.split("\n")
                found = self.unit(BLANK + first) + len(rest) + sum(self.unit(r) for r in rest if r)
            else:
                found = self.unit(BLANK + unit)
            if len(unit) <= CACHED_LENGTH:
                self.known[unit] = found
        return found


@lru_cache(maxsize=2)
def _counter(vocabulary: tuple[tuple[str, float], ...]) -> UnigramCounter:
    return UnigramCounter(vocabulary)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_chars`` of ``docs(doc_id, text)``, one row per row.

    The count is that of a unigram tokenizer with the file's pieces and scores, blanks as
    piece beginnings. Null and empty texts have 0 tokens. One pass, no shuffle; the
    vocabulary is broadcast, its size that of the file. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def count(batch: pa.RecordBatch) -> dict:
        counter, some = _counter(shared.value), texts(batch)
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([counter(t) for t in some], pa.int64()),
            "n_chars": pa.array([len(t) for t in some], pa.int64()),
        }

    schema = "doc_id long, n_tokens long, n_chars long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, count)
