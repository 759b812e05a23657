"""From outcome tables on disk to a summary, in one call."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollgate.operators.encode import Encoder, encode, hashed_terms
from tollgate.operators.fusion import IMAGE, TEXT
from tollgate.operators.outcomes import Outcomes, fitting_scales, impute_means, in_units
from tollgate.operators.splits import both_sides, in_domain, out_of_domain
from tollgate.operators.terms import MAX_TERMS, TfidfModel
from tollgate.plans.evaluate import LEARNED, Evaluation, Scales, evaluate, summary
from tollgate.session import written
from tollgate.sources.images import image_vectors, read_images, with_image_vectors
from tollgate.sources.sinks import save_run
from tollgate.sources.tables import dataset_list, read_outcomes


@dataclass(frozen=True)
class TextTfidf:
    """Take TF-IDF weights of the train texts' most frequent terms as text vectors.

    All terms count: with ``width`` None they take one dimension each, else their weights
    are projected to that many. By default the linear policies on text alone take them
    whole, as sparse rows, and the others projected to ``SKETCH_WIDTH``.
    """

    max_terms: int = MAX_TERMS
    width: int | str | None = "auto"
    seed: int = 42

    def whole(self, router: str | None, mode: str | None) -> bool:
        return self.width == "auto" and router in WHOLE_ROWS and mode == TEXT * 2


# Policies that take sparse rows.
WHOLE_ROWS = ("linear", "linearmf")
SKETCH_WIDTH = 1_024


@dataclass(frozen=True)
class Features:
    """How questions and images become vectors; without an image encoder the
    images count as zero vectors."""

    text: Callable[[], Encoder] | TextTfidf = hashed_terms(64)
    image: Callable[[], Encoder] | None = None
    image_dim: int = 0
    batch_size: int = 64


def with_vectors(
    items: DataFrame, is_train: Column, features: Features, root: str, router: str | None = None, mode: str | None = None
) -> DataFrame:
    """Add ``text_emb`` and ``img_emb``. TF-IDF needs a ``row_id`` of its own per
    row: items that share a text, or even an id, are texts of their own."""
    if isinstance(features.text, TextTfidf):
        texts = items.select("row_id", "question", is_train.alias("is_train"))
        model = TfidfModel.fit(texts.where("is_train"), "row_id", max_terms=features.text.max_terms)
        how = features.text
        if how.whole(router, mode):
            vectors = model.sparse(texts, "row_id")
        else:
            vectors = model.projected(texts, SKETCH_WIDTH if how.width == "auto" else how.width, how.seed, "row_id")
        items = items.join(vectors.withColumnsRenamed({"doc": "row_id", "vector": "text_emb"}), "row_id")
    else:
        items = encode(items, "question", features.text, "text_emb", features.batch_size)
    if features.image is None:
        return items.withColumn("img_emb", F.lit(None).cast("array<float>"))
    images = image_vectors(
        read_images(items.sparkSession, root), features.image, features.image_dim, features.batch_size
    )
    return with_image_vectors(items, images, features.image_dim)


def run(
    spark: SparkSession,
    root: str,
    datasets: str | Sequence[str],
    router: str = "linearmf",
    mode: str = "22",
    split: str = "in",
    train_share: float = 0.2,
    out_share: float = 0.2,
    seed: int = 42,
    policy=None,
    features: Features = Features(),
    scales: Scales | None = None,
    out_folder: str | None = None,
    **reading,
) -> tuple[Evaluation, DataFrame]:
    """Read, impute, split, fit, sweep and summarise; save the curve if told where.

    Outcomes are summed in whole units of 1 / ``scales``, which makes the curve
    the same on every run. By default the units are the finest that the data allow.
    """
    if split not in ("in", "out"):
        raise ValueError(f"split must be 'in' or 'out', not {split!r}")
    if router in LEARNED and features.image is None and IMAGE in mode:
        raise ValueError(f"mode {mode!r} takes image vectors, but there is no image encoder")
    names = dataset_list(datasets)
    outcomes = read_outcomes(spark, root, names, **reading)
    numbered = outcomes.items.withColumn("row_id", F.monotonically_increasing_id())
    outcomes = outcomes.with_items(written(numbered, "outcomes"))
    outcomes = impute_means(outcomes)
    scales = scales or Scales(*fitting_scales(outcomes))
    outcomes = in_units(outcomes, scales.perf, scales.cost)
    is_train = in_domain(outcomes.items, train_share, seed) if split == "in" else out_of_domain(names, out_share)
    both_sides(outcomes.items, is_train)
    if router in LEARNED:
        items = with_vectors(outcomes.items, is_train, features, root, router, mode)
        outcomes = Outcomes(written(items, "features"), outcomes.models)
    result = evaluate(router, outcomes, is_train, scales, mode, policy)
    label = "+".join(names)
    row = summary(result, router, label, mode)
    if out_folder is not None:
        save_run(out_folder, result, row)
    return result, row
