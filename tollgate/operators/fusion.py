"""One feature vector per item from its text and image vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tollgate.functions import vectors as v
from tollgate.operators.sparse import is_sparse

# Fixed values of the adaptive fusion.
EPS = 1e-8
ETA = 5.0
INTERACTION_WEIGHT = 0.5

# A spread of norms below this is rounding noise; its z-scores count as zero.
MIN_STD = 1e-6

TEXT, FUSED, IMAGE = "1", "2", "3"


@dataclass(frozen=True)
class ModalityStats:
    mean: tuple[float, ...]
    norm_mean: float
    norm_std: float

    @property
    def mean_norm(self) -> float:
        return math.sqrt(sum(x * x for x in self.mean))


@dataclass(frozen=True)
class BatchStats:
    text: ModalityStats
    img: ModalityStats


def _pair(df: DataFrame, text: str, img: str) -> DataFrame:
    """Both vectors in double precision, of one length; a missing image is zero."""
    t = F.col(text)
    i = F.coalesce(F.col(img), F.transform(t, lambda x: F.lit(0.0).cast("float")))
    t, i = v.truncate_pair(t, i)
    return df.withColumns({"_t": v.widen(t), "_i": v.widen(i)})


def statistics_row(df: DataFrame, text: str = "text_emb", img: str = "img_emb") -> DataFrame:
    """Mean vector and mean and spread of the norms, per modality, in one row.

    One aggregate with partial sums.
    """
    pair = _pair(df.select(text, img), text, img).withColumns(
        {"_nt": v.norm(F.col("_t")), "_ni": v.norm(F.col("_i"))}
    )
    return pair.agg(
        *[
            column.alias(f"{name}_{what}")
            for name, vec, norm in (("text", "_t", "_nt"), ("img", "_i", "_ni"))
            for what, column in (
                ("mean", vector_to_array(Summarizer.mean(array_to_vector(vec)))),
                ("norm_mean", F.avg(norm)),
                ("norm_std", F.stddev_pop(norm)),
            )
        ]
    )


def batch_statistics(df: DataFrame, text: str = "text_emb", img: str = "img_emb") -> BatchStats:
    """``statistics_row`` on the driver: 2 x dimension + 4 numbers."""
    row = statistics_row(df, text, img).first()
    return BatchStats(
        *[
            ModalityStats(tuple(row[f"{name}_mean"]), row[f"{name}_norm_mean"], row[f"{name}_norm_std"])
            for name in ("text", "img")
        ]
    )


def _confidence(vec: Column, norm: Column, stats: ModalityStats) -> Column:
    mean = F.lit(list(stats.mean))
    cosine = v.dot(vec, mean) / (norm * F.lit(stats.mean_norm) + EPS)
    if stats.norm_std < MIN_STD:
        z = F.lit(0.0)
    else:
        z = (norm - F.lit(stats.norm_mean)) / F.lit(stats.norm_std + EPS)
    typical = 1.0 / (1.0 + F.exp(-z))
    score = 0.5 * (cosine + 1.0) / 2.0 + 0.5 * typical
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def adaptive_fusion(
    df: DataFrame,
    stats: BatchStats | None = None,
    text: str = "text_emb",
    img: str = "img_emb",
    out: str = "x",
) -> DataFrame:
    """Weigh the modalities by confidence and add their product and distance.

    A vector is trusted the more, the closer it points to its batch mean and the
    longer it is against the batch. ``stats`` defaults to those of ``df``.
    """
    stats = stats or batch_statistics(df, text, img)
    staged = _pair(df, text, img).withColumns(
        {"_nt": v.norm(F.col("_t")), "_ni": v.norm(F.col("_i"))}
    )
    staged = staged.withColumns(
        {
            "_et": F.exp(ETA * _confidence(F.col("_t"), F.col("_nt"), stats.text)),
            "_ei": F.exp(ETA * _confidence(F.col("_i"), F.col("_ni"), stats.img)),
        }
    )
    staged = staged.withColumn("_s", F.col("_et") + F.col("_ei") + EPS).withColumns(
        {"_wt": F.col("_et") / F.col("_s"), "_wi": F.col("_ei") / F.col("_s")}
    )
    weighted = v.added(
        v.scaled(F.col("_t"), F.col("_wt")), v.scaled(F.col("_i"), F.col("_wi"))
    )
    interaction = F.zip_with(
        "_t", "_i", lambda t, i: INTERACTION_WEIGHT * t * i + INTERACTION_WEIGHT * F.abs(t - i)
    )
    staged = staged.withColumn("_f", v.added(weighted, interaction))
    staged = staged.withColumn("_nf", v.norm(F.col("_f")) + EPS)
    return staged.withColumn(out, v.divided(F.col("_f"), F.col("_nf"))).drop(
        "_t", "_i", "_nt", "_ni", "_et", "_ei", "_s", "_wt", "_wi", "_f", "_nf"
    )


def average_features(
    df: DataFrame, flag: str = FUSED, text: str = "text_emb", img: str = "img_emb", out: str = "x"
) -> DataFrame:
    """Text (flag 1), mean of text and image (2) or image vector (3).

    Sparse text vectors stay as they are; only flag 1 takes them.
    """
    if flag == TEXT and is_sparse(df, text):
        return df.withColumn(out, F.col(text))
    if flag == TEXT:
        return df.withColumn(out, v.widen(F.col(text)))
    if flag == IMAGE:
        return df.withColumn(out, v.widen(F.col(img)))
    return _pair(df, text, img).withColumn(out, v.average(F.col("_t"), F.col("_i"))).drop("_t", "_i")


def adaptive_features(
    df: DataFrame,
    flag: str = FUSED,
    stats: BatchStats | None = None,
    text: str = "text_emb",
    img: str = "img_emb",
    out: str = "x",
) -> DataFrame:
    """Text vector for flag 1; every other flag takes the adaptive fusion."""
    if flag == TEXT:
        return df.withColumn(out, v.widen(F.col(text)))
    return adaptive_fusion(df, stats, text, img, out)


def cross_features(
    df: DataFrame, flag: str = FUSED, text: str = "text_emb", img: str = "img_emb", out: str = "x"
) -> DataFrame:
    """Both vectors whole, with their product and distance; flag 1 sees a zero image.

    Product and distance run over the dimensions that both have.
    """
    t = v.widen(F.col(text))
    zero = v.zeros_like(t)
    image = v.zeros_like(v.widen(F.col(img))) if flag == TEXT else v.widen(F.col(img))
    return df.withColumn(out, v.interaction(t, F.coalesce(image, zero)))
