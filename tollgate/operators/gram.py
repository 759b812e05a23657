"""Second moments of features and targets in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

MAX_WIDTH = 4096


@dataclass(frozen=True)
class Moments:
    """``[1 X Y]' [1 X Y]`` with its parts by name."""

    gram: np.ndarray
    dim: int

    @property
    def n(self) -> float:
        return self.gram[0, 0]

    @property
    def x_mean(self) -> np.ndarray:
        return self.gram[0, 1 : 1 + self.dim] / self.n

    @property
    def y_mean(self) -> np.ndarray:
        return self.gram[0, 1 + self.dim :] / self.n

    @property
    def xx(self) -> np.ndarray:
        return self.gram[1 : 1 + self.dim, 1 : 1 + self.dim]

    @property
    def xy(self) -> np.ndarray:
        return self.gram[1 : 1 + self.dim, 1 + self.dim :]

    @property
    def xx_centred(self) -> np.ndarray:
        return self.xx - self.n * np.outer(self.x_mean, self.x_mean)

    @property
    def xy_centred(self) -> np.ndarray:
        return self.xy - self.n * np.outer(self.x_mean, self.y_mean)


def moments(df: DataFrame) -> Moments:
    """Moments of ``x`` against ``perf`` and ``cost``; missing targets count as zero.

    Each task sums its own rows and hands on one matrix, row by row; the rows
    are added up in parallel. The matrix is as wide as the features, whatever
    the number of items, and wider ones than ``MAX_WIDTH`` are refused.
    """
    rows = df.select(
        F.col("x").cast("array<double>").alias("x"),
        F.transform(
            F.concat(F.col("perf").cast("array<double>"), F.col("cost").cast("array<double>")),
            lambda y: F.coalesce(F.nanvl(y, F.lit(0.0)), F.lit(0.0)),
        ).alias("y"),
    )
    first = rows.select(F.size("x"), F.size("y")).first()
    if first is None:
        raise ValueError("no train rows")
    dim, targets = first
    if 1 + dim + targets > MAX_WIDTH:
        raise ValueError(f"{dim} features are too many for a dense fit (at most {MAX_WIDTH})")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((1 + dim + targets, 1 + dim + targets))
        for pdf in batches:
            z = np.hstack(
                [np.ones((len(pdf), 1)), np.vstack(pdf["x"].to_numpy()), np.vstack(pdf["y"].to_numpy())]
            )
            gram += z.T @ z
        if gram[0, 0]:
            yield pd.DataFrame({"i": np.arange(len(gram)), "row": list(gram)})

    parts = rows.mapInPandas(add_up, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).collect()
    gram = np.zeros((1 + dim + targets, 1 + dim + targets))
    for r in summed:
        gram[r["i"]] = r["row"].toArray()
    return Moments(gram, dim)
