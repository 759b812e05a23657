"""Linear policies, from one pass of second moments or, for wide and sparse rows, from products."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tollgate.operators.gram import MAX_WIDTH, moments
from tollgate.operators.sparse import WideRows, is_sparse, least_squares, low_rank_ridge, row_times
from tollgate.session import once


@dataclass
class FittedLinear:
    """``x @ weights + intercept``: performance of every model, then cost."""

    weights: np.ndarray
    intercept: np.ndarray

    def predict(self, test: DataFrame) -> DataFrame:
        if not is_sparse(test, "x"):
            return with_predictions(test, LinearMap(self.weights, self.intercept))
        m = len(self.intercept) // 2
        shift = F.array(*[F.lit(float(b)) for b in self.intercept])
        predicted = F.zip_with(row_times("x", self.weights, test), shift, lambda p, b: p + b)
        return (
            test.withColumn("_pred", predicted)
            .withColumns({"perf_pred": F.slice("_pred", 1, m), "cost_pred": F.slice("_pred", m + 1, m)})
            .drop("_pred")
        )


@dataclass
class LinearMap:
    weights: np.ndarray
    intercept: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    @property
    def width(self) -> int:
        return len(self.intercept)


def with_predictions(test: DataFrame, function) -> DataFrame:
    """Add both predictions by a batch function of the feature matrix.

    The function's weights are as large as the features are wide and are sent to
    the workers once.
    """
    shared = test.sparkSession.sparkContext.broadcast(cloudpickle.dumps(function))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = pickle.loads(shared.value)
        for x in batches:
            rows = predict(np.vstack(x.to_numpy()).astype(float)) if len(x) else []
            yield pd.Series(list(rows), dtype=object)

    m = function.width // 2
    return (
        test.withColumn("_pred", once(run)(F.col("x").cast("array<double>")))
        .withColumns(
            {"perf_pred": F.slice("_pred", 1, m), "cost_pred": F.slice("_pred", m + 1, m)}
        )
        .drop("_pred")
    )


def needs_products(train: DataFrame) -> bool:
    """Sparse rows, and rows too wide for a moment matrix."""
    if is_sparse(train, "x"):
        return True
    first = train.select(F.size("x") + F.size("perf") + F.size("cost") + 1).first()
    return first is not None and first[0] > MAX_WIDTH


def _pinv(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a moment matrix; directions lost to rounding are left out."""
    return np.linalg.pinv(a, rcond=1e-10, hermitian=True)


@dataclass
class LinearPolicy:
    """Least squares with intercept for every model's performance and cost."""

    def fit(self, train: DataFrame) -> FittedLinear:
        if needs_products(train):
            return FittedLinear(*least_squares(WideRows.of(train)))
        m = moments(train)
        weights = _pinv(m.xx_centred) @ m.xy_centred
        return FittedLinear(weights, m.y_mean - m.x_mean @ weights)


@dataclass
class LowRankPolicy:
    """Ridge regression on the leading singular directions of the features."""

    rank: int = 128
    alpha: float = 1.0

    def fit(self, train: DataFrame) -> FittedLinear:
        if needs_products(train):
            weights, intercept, _ = low_rank_ridge(WideRows.of(train), self.rank, self.alpha)
            return FittedLinear(weights, intercept)
        m = moments(train)
        rank = max(1, min(self.rank, int(m.n), m.dim))
        _, vectors = np.linalg.eigh(m.xx)
        leading = vectors[:, ::-1][:, :rank]
        penalised = leading.T @ m.xx_centred @ leading + self.alpha * np.eye(rank)
        weights = leading @ np.linalg.solve(penalised, leading.T @ m.xy_centred)
        return FittedLinear(weights, m.y_mean - m.x_mean @ weights)
