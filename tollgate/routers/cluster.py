"""Cluster policies: predict the mean outcomes of the cluster an item falls in."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.mllib.clustering import KMeans, KMeansModel
from pyspark.mllib.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from tollgate.functions.draws import digest
from tollgate.session import once, small_side

log = logging.getLogger(__name__)


def cluster_profile(items: DataFrame, models: int, cluster: str = "cluster") -> DataFrame:
    """Mean performance and cost per cluster and model, missing values left out.

    One row per cluster. The sums are formed before the shuffle, so a cluster
    that holds most items costs no more than any other.
    """

    def means(name: str):
        return F.array(*[F.avg(F.get(name, F.lit(j))) for j in range(models)])

    return items.groupBy(cluster).agg(
        means("perf").alias("perf_pred"), means("cost").alias("cost_pred")
    )


def with_profile(
    items: DataFrame, profile: DataFrame, clusters: int, models: int, cluster: str = "cluster"
) -> DataFrame:
    """Look the profile up for every item; it has ``clusters`` rows at most."""
    side = small_side(profile, clusters, 16 * (2 * models + 4))
    return items.join(side, cluster, "left")


def first_centres(train: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first ``k`` distinct vectors of the train rows in md5 order of seed and id.

    Copies are put together before the order, so any number of them counts once; ``k``
    rows reach the driver.
    """
    keyed = train.select("x", digest(seed, F.col("item_id")).alias("key"))
    firsts = keyed.groupBy("x").agg(F.min("key").alias("key")).orderBy("key", "x").limit(k)
    return np.asarray([tuple(map(float, r["x"])) for r in firsts.collect()])


@dataclass
class ClusterPolicy:
    """k-means on the features, cluster means as predictions.

    Lloyd rounds from centres that hang on the seed and the ids alone, so the clusters
    follow neither the partitions nor their order. Fewer distinct vectors than clusters
    give fewer clusters.
    """

    clusters: int = 20
    seed: int = 42
    max_iter: int = 100

    def fit(self, train: DataFrame) -> FittedClusters:
        rows = train.select(
            "item_id", F.col("x").cast("array<double>").alias("x"), "perf", "cost"
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, models = rows.agg(F.count(F.lit(1)), F.max(F.size("perf"))).first()
            if not n:
                raise ValueError("no train rows")
            if self.clusters > n:
                log.warning("%d clusters are more than the %d train rows", self.clusters, n)
            start = first_centres(rows, min(self.clusters, n), self.seed)
            vectors = rows.select("x").rdd.map(lambda r: Vectors.dense(r[0]))
            fitted = KMeans.train(
                vectors, len(start), self.max_iter, initialModel=KMeansModel([Vectors.dense(c) for c in start]), epsilon=0.0
            )
            centres = np.asarray([np.asarray(c) for c in fitted.clusterCenters])
            profile = cluster_profile(nearest_centre(rows, centres), models).collect()
        finally:
            rows.unpersist()
        return FittedClusters(centres, profile, models)


def nearest_centre(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Set ``cluster``, the number of the nearest centre, the first among equals.

    The centres are clusters x dimensions numbers, sent along with the function.
    """

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        points = np.asarray(x.tolist(), dtype=float).reshape(len(x), -1)
        out = []
        for i in range(0, len(points), 1_000):
            some = points[i : i + 1_000, None, :] - centres[None, :, :]
            out.append(np.round((some * some).sum(axis=2), 12).argmin(axis=1))
        return pd.Series(np.concatenate(out) if out else [], dtype="int32")

    return items.withColumn("cluster", once(nearest)(F.col("x").cast("array<double>")))


@dataclass
class FittedClusters:
    centres: np.ndarray
    profile: list
    models: int

    @property
    def clusters(self) -> int:
        return len(self.centres)

    def assign(self, items: DataFrame) -> DataFrame:
        """Set ``cluster``, the index of the nearest centre."""
        return nearest_centre(items.drop("cluster"), self.centres)

    def predict(self, test: DataFrame) -> DataFrame:
        schema = "cluster int, perf_pred array<double>, cost_pred array<double>"
        profile = test.sparkSession.createDataFrame(self.profile, schema)
        return with_profile(self.assign(test), profile, self.clusters, self.models)
