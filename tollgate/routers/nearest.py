"""Nearest-neighbour policy: predict the mean outcomes of the k nearest train items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tollgate.operators.neighbours import NeighbourIndex


@dataclass
class NearestPolicy:
    k: int = 50
    metric: str = "cosine"

    def fit(self, train: DataFrame) -> NeighbourIndex:
        return NeighbourIndex(train, self.k, self.metric)
