"""Batched encoders over text or image columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tollgate.functions.text import WORD
from tollgate.session import once, shuffle_partitions

Encoder = Callable[[Sequence], np.ndarray]


def encode(
    df: DataFrame,
    column: str,
    make_encoder: Callable[[], Encoder],
    out: str,
    batch_size: int = 64,
    normalise: bool = True,
    spread_by: str | None = None,
) -> DataFrame:
    """Add the vectors an encoder gives for ``column``.

    ``make_encoder`` runs once per worker task and loads the model; the encoder
    maps a batch of values to a matrix. Only the one column travels to Python.
    Encoding outweighs a shuffle by far: ``spread_by`` names an id to deal the
    rows out by where they come in fewer partitions than there are cores.
    """
    if spread_by is not None:
        df = df.repartition(shuffle_partitions(df.sparkSession), spread_by)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(batch), batch_size):
                part = np.asarray(encoder(list(batch.iloc[start : start + batch_size])), dtype=np.float64)
                if normalise:
                    lengths = np.linalg.norm(part, axis=1, keepdims=True)
                    part = part / np.where(lengths > 0, lengths, 1.0)
                rows += list(part.astype(np.float32))
            yield pd.Series(rows, index=batch.index)

    return df.withColumn(out, once(run)(F.col(column)))


def hashed_terms(dim: int = 64) -> Callable[[], Encoder]:
    """Encoder counting words and word pairs in ``dim`` slots picked by md5."""

    def make() -> Encoder:
        word = regex.compile(WORD)
        slots: dict[str, int] = {}

        def slot(term: str) -> int:
            if term not in slots:
                if len(slots) >= 500_000:
                    slots.clear()
                slots[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim
            return slots[term]

        def run(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                found = word.findall((text or "").lower())
                pairs = [f"{a} {b}" for a, b in zip(found, found[1:])]
                slots_hit = [slot(t) for t in found + pairs]
                out[i] = np.bincount(slots_hit, minlength=dim) if slots_hit else 0.0
            return out

        return run

    return make


# What decoders raise on broken bytes. An encoder that misses a file of its own, or a
# service, fails with one of the second; these and all other errors rise.
UNREADABLE = (OSError, ValueError, EOFError, SyntaxError)
OWN_FAULTS = (FileNotFoundError, PermissionError, ConnectionError, TimeoutError)


def or_zero(encoder: Encoder, dim: int, unreadable: tuple[type[Exception], ...] = UNREADABLE) -> Encoder:
    """Give unreadable or missing inputs the zero vector instead of failing.

    Batches go to the encoder whole. Only a batch that holds something unreadable is
    taken apart, by halves, so that the readable ones stay in batches. Errors other than
    ``unreadable`` rise: an encoder without its weights must not give zeros.
    """

    def some(values: list, places: np.ndarray, out: np.ndarray) -> None:
        if not len(places):
            return
        try:
            out[places] = np.asarray(encoder([values[i] for i in places]), dtype=np.float64)
        except unreadable as error:
            if isinstance(error, OWN_FAULTS):
                raise
            if len(places) > 1:
                half = len(places) // 2
                some(values, places[:half], out)
                some(values, places[half:], out)

    def run(values: Sequence) -> np.ndarray:
        out = np.zeros((len(values), dim))
        some(list(values), np.asarray([i for i, v in enumerate(values) if v is not None], dtype=int), out)
        return out

    return run
