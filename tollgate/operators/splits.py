"""Train / test splits that do not depend on row order or partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tollgate.functions.draws import digest
from tollgate.functions.names import data_set_key, data_set_keys

_DIGITS = 3  # hex digits refined per pass: at most 4096 counts reach the driver
_COLLECT = 4096  # keys read once few enough share a prefix


def in_domain(df: DataFrame, share: float = 0.2, seed: int = 42, id_col: str = "item_id") -> Column:
    """Condition that holds for exactly ``floor(share * rows)`` shuffled rows.

    Rows are ordered by md5 of seed and id. Instead of sorting them, the digest
    of the last train row is found by counting digests per prefix, so only
    counts are shuffled. Rows that share an id stay on one side.
    """
    key = digest(seed, F.col(id_col))
    last = _kth_smallest(df.select(key.alias("key")), share)
    return (key <= F.lit(last)) if last is not None else F.lit(False)


def _kth_smallest(keys: DataFrame, share: float) -> str | None:
    prefix, rank = "", None
    while True:
        width = len(prefix) + _DIGITS
        counts = (
            keys.where(F.col("key").startswith(prefix))
            .groupBy(F.substring("key", 1, width).alias("prefix"))
            .count()
            .collect()
        )
        if rank is None:
            rank = math.floor(share * sum(r["count"] for r in counts) + 1e-9)
            if rank < 1:
                return None
        for row in sorted(counts):
            if rank <= row["count"]:
                prefix, size = row["prefix"], row["count"]
                break
            rank -= row["count"]
        if len(prefix) > 32 - _DIGITS:
            return prefix + "f" * (32 - len(prefix))
        if size <= _COLLECT:
            found = keys.where(F.col("key").startswith(prefix)).collect()
            return sorted(r["key"] for r in found)[rank - 1]


def out_of_domain(datasets: Sequence[str], share: float = 0.2, column: str = "dataset") -> Column:
    """Condition for the rows of the first ``max(1, int(share * datasets))`` data sets.

    Names are compared in canonical form and through the table of known aliases, so
    spelling does not empty a side. Whether rows of both sides are there is for the
    caller to count (``both_sides``).
    """
    names = [data_set_key(d) for d in datasets]
    train = names[: max(1, int(len(names) * share))]
    if not train or set(train) >= set(names):
        raise ValueError("an out-of-domain split needs data sets on both sides")
    return data_set_keys(F.col(column)).isin(*train)


def both_sides(df: DataFrame, is_train: Column) -> tuple[int, int]:
    """Rows of the train and the test side; ``ValueError`` if either has none."""
    side = F.coalesce(is_train, F.lit(False))
    train, test = df.agg(F.count(F.when(side, 1)), F.count(F.when(~side, 1))).first()
    if not train or not test:
        raise ValueError(f"the split leaves {train} train rows and {test} test rows")
    return train, test
