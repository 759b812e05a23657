"""Image vectors for items.

Images are encoded where they are read, each file once; only the vectors are
joined to the items, never the bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollgate.operators.encode import Encoder, encode, or_zero


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(img_path, content)`` of all files below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("img_path"), "content")


def image_vectors(
    images: DataFrame,
    make_encoder: Callable[[], Encoder],
    dim: int,
    batch_size: int = 64,
    lenient: bool = True,
    normalise: bool = True,
) -> DataFrame:
    """``(img_path, img_emb)``. A file that cannot be decoded (``encode.UNREADABLE``)
    gives the zero vector, or an error unless ``lenient``; other errors always rise."""

    def make() -> Encoder:
        encoder = make_encoder()
        return or_zero(encoder, dim) if lenient else encoder

    return encode(images, "content", make, "img_emb", batch_size, normalise).select(
        "img_path", "img_emb"
    )


def with_image_vectors(items: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Add ``img_emb`` by path; the zero vector where there is no such image.

    Items without a path match nothing and stay out of the join, where they
    would all meet in one partition.
    """
    zero = F.lit([0.0] * dim).cast("array<float>")
    has_path = F.coalesce(F.col("img_path"), F.lit("")) != ""
    joined = items.where(has_path).join(vectors, "img_path", "left")
    return joined.withColumn("img_emb", F.coalesce("img_emb", zero)).unionByName(
        items.where(~has_path).withColumn("img_emb", zero)
    )
