"""One callable per registered query: ``(spark, folder) -> DataFrame``.

Each reads the whole of the given tables and aliases its columns as the SQL in
``oracles`` does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollgate.catalog import fixtures as fx
from tollgate.functions import names as n
from tollgate.functions import vectors as v
from tollgate.operators import fusion
from tollgate.operators.encode import encode, hashed_terms
from tollgate.operators.frontier import (
    best_single_model,
    curve_area,
    curve_metrics,
    pareto_frontier,
    single_models,
)
from tollgate.operators.gram import moments
from tollgate.operators.neighbours import NeighbourIndex
from tollgate.operators.outcomes import (
    Outcomes,
    from_wide,
    impute_means,
    in_units,
    normalised_costs,
    zero_missing,
)
from tollgate.operators.splits import in_domain, out_of_domain
from tollgate.operators.sweep import (
    budget_sweep,
    choice_under_budget,
    oracle_predictions,
    random_sweep,
)
from tollgate.operators.sparse import WideRows, low_rank_ridge, row_times
from tollgate.operators.terms import TfidfModel, top_terms
from tollgate.plans import evaluate as ev
from tollgate.routers import LinearPolicy, LowRankPolicy
from tollgate.routers.linear import FittedLinear
from tollgate.routers.cluster import cluster_profile, with_profile
from tollgate.session import scratch_path, written
from tollgate.sources import tables
from tollgate.sources.sinks import save_run
from tollgate.sources.synthetic import synthetic_outcomes

BUDGET_CENTS = 3_000_000
NEIGHBOURS = 50
ROOT = "/data/outcomes"

# Spellings and ids the name queries run over, picked by document number.
SPELLINGS = (
    "Math-Verse", "math vision", "MATHVISTA", "OCR Bench", "RealWorldQA", "mm_star",
    "SEED-Bench", "SEEDBench2_Plus", "SEEDBenchv2Plus", "toy",
)
ID_STEMS = (
    "MathVerse", "MathVision", "MathVista", "OCRBench", "RealWorldQA", "MMStar",
    "SEEDBench2_Plus", "SEEDBench2", "MathVistaX", "toy",
)
WANTED = ("Math Vista", "seedbench", "MMStar")


# ---- outcome tables -------------------------------------------------------


def _wide_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a wide outcome table; the model names hold dots."""
    long = fx.order_outcomes_long(spark, folder)
    lines = range(1, 8)
    wide = long.groupBy("item_id", "dataset").agg(
        *[F.max(F.when(F.col("model") == f"m{i}", F.col("is_correct"))).alias(f"line.{i}_correct") for i in lines],
        *[F.max(F.when(F.col("model") == f"m{i}", F.col("cost_cents"))).alias(f"line.{i}_cost") for i in lines],
    )
    return wide.withColumn("question", F.concat_ws(" ", F.lit("order"), "item_id"))


def infer_long_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    wide = _wide_orders(spark, folder)
    return from_wide(wide, F.col("item_id")).long().select(
        "item_id", "dataset", "question", "answer", "model_idx", "model", "is_correct", "cost"
    )


def imputed_means(spark: SparkSession, folder: str) -> DataFrame:
    filled = impute_means(fx.order_outcomes(spark, folder)).long()
    return filled.select(
        "item_id", "dataset", "model",
        F.round("is_correct", 6).alias("is_correct"), F.round("cost", 4).alias("cost"),
    )


def coalesce_targets(spark: SparkSession, folder: str) -> DataFrame:
    return zero_missing(fx.order_outcomes(spark, folder)).long().select(
        "item_id", "model", "is_correct", "cost"
    )


def model_cost_norm(spark: SparkSession, folder: str) -> DataFrame:
    costs = normalised_costs(fx.order_units(spark, folder))
    return costs.select(
        "model_idx", "model", F.round("mean_cost", 4).alias("mean_cost"), F.round("cost_norm", 6).alias("cost_norm")
    )


def _test_orders(spark: SparkSession, folder: str) -> Outcomes:
    outcomes = fx.order_units(spark, folder)
    return outcomes.with_items(outcomes.items.where(~in_domain(outcomes.items)))


def _order_baselines(spark: SparkSession, folder: str) -> DataFrame:
    return single_models(_test_orders(spark, folder), fx.ORDER_SCALES.perf, fx.ORDER_SCALES.cost)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def single_model_baselines(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_order_baselines(spark, folder), "accuracy", "avg_cost")


def best_single(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(best_single_model(_order_baselines(spark, folder)), "accuracy", "avg_cost")


def _draw_outcomes(documents: DataFrame, *keep: str) -> DataFrame:
    """Wide outcome table over documents, with missing cells."""
    doc = F.col("doc_id")

    def correct(m: int) -> Column:
        return F.when((doc + m) % 9 != 0, ((doc * 7919 + 104729 * m) % 1000 < 500 + 100 * m).cast("int"))

    def cost(m: int) -> Column:
        return F.when((doc + m) % 11 != 0, (800 + (doc * 31 + 17 * m) % 401) * (m + 1))

    return documents.select(
        doc.cast("string").alias("doc_id"),
        F.col("text").alias("question"),
        F.col("lang").alias("answer"),
        "lang",
        *keep,
        *[correct(m).alias(f"gate-{m}.0_correct") for m in range(3)],
        *[cost(m).alias(f"gate-{m}.0_cost") for m in range(3)],
    )


def _write_csv(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def parquet_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as one Parquet outcome table and read back."""
    root = scratch_path(spark, "parquet")
    wide = _draw_outcomes(fx.table(spark, folder, "documents")).drop("lang")
    wide.write.parquet(f"{root}/whole.parquet")
    read = tables.read_outcomes(
        spark, root, "Whole", ending=".parquet", list_images=False, item_id=F.col("doc_id").cast("bigint")
    )
    return read.long().select(
        "item_id", "dataset", F.md5("question").alias("question_md5"), "answer", "img_path",
        "model_idx", "model", "is_correct", "cost",
    )


def csv_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as one outcome CSV per language and read back."""
    wide = _draw_outcomes(fx.table(spark, folder, "documents"))
    root = scratch_path(spark, "csv")
    # one scan; the languages are those of the data, a folder each
    _write_csv(wide.withColumn("name", F.concat("lang", F.lit(".csv"))).drop("lang"), root, "name")
    languages = wide.select(F.upper("lang").alias("lang")).distinct().collect()
    read = tables.read_outcomes(
        spark, root, "+ +".join(f"Name={r['lang']}" for r in languages), list_images=False,
        item_id=F.col("doc_id").cast("bigint"),
    )
    return read.long().select(
        "item_id", F.replace("dataset", F.lit("name="), F.lit("")).alias("dataset"), F.md5("question").alias("question_md5"), "answer", "img_path",
        "model_idx", "model", "is_correct", "cost",
    )


def _instance_id(documents: DataFrame) -> DataFrame:
    """Instance ids of all shapes: prefix and number, bare prefix, unknown, NULL."""
    doc = F.col("doc_id")
    stem = F.element_at(F.lit(list(ID_STEMS)), (doc % len(ID_STEMS)).cast("int") + 1)
    idx = (
        F.when(doc % 13 == 0, F.lit(None))
        .when(doc % 7 == 0, stem)
        .otherwise(F.concat(stem, F.lit("_"), doc.cast("string")))
    )
    return documents.withColumn("dataset_idx", idx)


def merged_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as one merged CSV; only the wanted data sets are read."""
    documents = _instance_id(fx.table(spark, folder, "documents"))
    wide = _draw_outcomes(documents, "dataset_idx").drop("lang")
    root = scratch_path(spark, "merged")
    _write_csv(wide, f"{root}/all.csv")
    read = tables.read_outcomes(
        spark, root, WANTED, merged_name="all.csv", list_images=False, item_id=F.col("doc_id").cast("bigint")
    )
    return read.items.select(
        "item_id", "dataset", F.md5("question").alias("question_md5"),
        F.replace("img_path", F.lit(root), F.lit("")).alias("img_path"),
        *[F.get("perf", F.lit(m)).alias(f"perf_{m}") for m in range(3)],
        *[F.get("cost", F.lit(m)).alias(f"cost_{m}") for m in range(3)],
    )


def filter_datasets(spark: SparkSession, folder: str) -> DataFrame:
    documents = _instance_id(fx.table(spark, folder, "documents"))
    return tables.from_merged(documents, WANTED).select("doc_id", "dataset_idx", "dataset")


def union_datasets(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.table(spark, folder, "documents").select(
        F.lit("documents").alias("dataset"), F.md5("text").alias("question_md5"), "lang"
    )
    turns = fx.table(spark, folder, "conversations").select(
        "role", F.md5("text").alias("question_md5"), F.lit("conversations").alias("dataset")
    )
    pages = fx.table(spark, folder, "pages").select(
        F.md5("html").alias("question_md5"), "url", F.lit("pages").alias("dataset")
    )
    return tables.union_by_name([documents, turns, pages])


def made_up_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    ids = fx.table(spark, folder, "orders").select(F.col("o_orderkey").alias("item_id"))
    long = synthetic_outcomes(ids).long()
    return long.select("item_id", "model_idx", "model", "is_correct", F.round("cost", 9).alias("cost"))


# ---- names, paths, splits -------------------------------------------------


def canon_names(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.table(spark, folder, "documents")
    spelled = F.element_at(F.lit(list(SPELLINGS)), (F.col("doc_id") % len(SPELLINGS)).cast("int") + 1)
    return documents.select(
        "doc_id",
        n.canonical(F.concat_ws(" - ", F.upper("source"), "lang")).alias("source_name"),
        n.canonical(spelled).alias("name"),
        n.alias_prefix(spelled).alias("prefix"),
    )


def prefix_match(spark: SparkSession, folder: str) -> DataFrame:
    documents = _instance_id(fx.table(spark, folder, "documents"))
    return documents.select("doc_id", "dataset_idx", n.longest_prefix(F.col("dataset_idx")).alias("prefix"))


def image_path_strings(spark: SparkSession, folder: str) -> DataFrame:
    documents = _instance_id(fx.table(spark, folder, "documents"))
    idx = F.col("dataset_idx")
    return documents.select(
        "doc_id", n.folder_of(idx).alias("folder"), n.default_image_path(idx, ROOT).alias("img_path")
    )


def image_path_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths back-filled from a listing that has some files, some twice."""
    documents = _instance_id(fx.table(spark, folder, "documents")).select("doc_id", "dataset_idx")
    idx, doc = F.col("dataset_idx"), F.col("doc_id")
    stem = F.concat(F.lit(ROOT + "/"), n.folder_of(idx), F.lit("/"), n.image_stem(idx))
    endings = F.when(doc % 3 == 0, F.lit([".webp", ".png"])).when(doc % 3 == 1, F.lit([".jpeg", ".txt"]))
    listing = documents.select(stem.alias("stem"), F.explode(endings).alias("ending")).select(
        F.concat("stem", "ending").alias("path")
    )
    return tables.backfilled_paths(documents, ROOT, listing.where(F.col("path").isNotNull()))


def resolve_paths(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    given = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/mnt/shots/"), page, F.lit(".png")))
        .when(F.col("page_id") % 4 == 1, F.lit(None))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("./shots/"), page, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("../other/"), page, F.lit(".jpg")))
    )
    return fx.table(spark, folder, "pages").select(
        "page_id", n.resolve_path(given, F.lit(ROOT + "/pages")).alias("img_path")
    )


def split_in(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.questions(spark, folder)
    return documents.select("item_id", "dataset", in_domain(documents).alias("is_train"))


def split_out(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.questions(spark, folder)
    is_train = out_of_domain([f"SRC {i}" for i in range(20)], share=0.25)
    return documents.select("item_id", "dataset", is_train.alias("is_train"))


# ---- sweeps and metrics ---------------------------------------------------


def _order_points(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = fx.order_units(spark, folder)
    return budget_sweep(oracle_predictions(outcomes.items), fx.ORDER_SCALES.perf, fx.ORDER_SCALES.cost)


def _points(points: DataFrame) -> DataFrame:
    # whole sums divided once: the means need no rounding to compare
    return points.drop("bucket")


def oracle_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _points(_order_points(spark, folder))


def random_points(spark: SparkSession, folder: str) -> DataFrame:
    items = _test_orders(spark, folder)
    return random_sweep(
        items.items, len(items.models), perf_scale=fx.ORDER_SCALES.perf, cost_scale=fx.ORDER_SCALES.cost
    )


def argmax_under_budget(spark: SparkSession, folder: str) -> DataFrame:
    items = oracle_predictions(fx.order_units(spark, folder).items)
    return choice_under_budget(items, BUDGET_CENTS).select(
        "item_id", "dataset", "model_idx", "perf", "cost", "feasible"
    )


def frontier_points(spark: SparkSession, folder: str) -> DataFrame:
    return pareto_frontier(_order_points(spark, folder)).select("cost", "performance")


def trapezoid_auc(spark: SparkSession, folder: str) -> DataFrame:
    area = curve_area(pareto_frontier(_order_points(spark, folder)))
    return _rounded(area, "min_cost", "max_cost", "peak").withColumn("area", F.round("area", 2))


def metrics_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Perfect-information policy on the test orders."""
    result = ev.evaluate("oracle", *_orders_split(spark, folder), fx.ORDER_SCALES)
    return _rounded(result.metrics, "nauc", "ps", "qnc")


def _orders_split(spark: SparkSession, folder: str) -> tuple[Outcomes, Column]:
    outcomes = fx.order_units(spark, folder)
    return outcomes, in_domain(outcomes.items)


def random_metrics(spark: SparkSession, folder: str) -> DataFrame:
    result = ev.evaluate("random", *_orders_split(spark, folder), fx.ORDER_SCALES)
    return _rounded(result.metrics, "nauc", "ps", "qnc")


def _by_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Test orders with the mean outcomes of the train orders of their priority."""
    outcomes, is_train = _orders_split(spark, folder)
    models = len(outcomes.models)
    profile = written(cluster_profile(outcomes.items.where(is_train), models, "dataset"), "profile")
    return with_profile(outcomes.items.where(~is_train), profile, profile.count(), models, "dataset")


def sweep_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """As below, but one priority has no train orders: its test orders take model 0 throughout."""
    outcomes, is_train = _orders_split(spark, folder)
    models = len(outcomes.models)
    seen = outcomes.items.where(is_train & (F.col("dataset") != "1-URGENT"))
    profile = written(cluster_profile(seen, models, "dataset"), "profile")
    test = with_profile(outcomes.items.where(~is_train), profile, profile.count(), models, "dataset")
    return _points(budget_sweep(test, fx.ORDER_SCALES.perf, fx.ORDER_SCALES.cost))


def split_out_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Folders as the merged loader stamps them, split by names spelled otherwise."""
    documents = _instance_id(fx.table(spark, folder, "documents"))
    stamped = documents.withColumn("dataset", n.folder_of(F.col("dataset_idx")))
    is_train = out_of_domain(["seedbench", "Math Vista", "MMStar", "OCR Bench"], share=0.25)
    return stamped.select("doc_id", "dataset", is_train.alias("is_train"))


def saved_run(spark: SparkSession, folder: str) -> DataFrame:
    """Points, frontier and summary of the orders, written as JSON and read back."""
    out = scratch_path(spark, "run")
    result = ev.evaluate("oracle", *_orders_split(spark, folder), fx.ORDER_SCALES)
    save_run(out, result, ev.summary(result, "oracle", "orders", "22"))
    summary = spark.read.json(f"{out}/summary")
    points = spark.read.json(f"{out}/points").agg(F.count("*").alias("curve_points"))
    flat = summary.select(
        "router", "dataset", F.col("mode").cast("string").alias("mode"), "metrics.*",
        F.size("single_model").alias("models"), "frontier_points",
    )
    return _rounded(flat.crossJoin(points), "nauc", "ps", "qnc")  # one row each


def budget_sweep_given_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _points(budget_sweep(_by_priority(spark, folder), fx.ORDER_SCALES.perf, fx.ORDER_SCALES.cost))


# ---- features -------------------------------------------------------------


def _exploded(df: DataFrame, column: str) -> DataFrame:
    # the outer form adds no filter that works the vector out a second time
    return df.select("item_id", F.posexplode_outer(column).alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


def average_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(fusion.average_features(fx.vector_outcomes(spark, folder).items), "x")


def adaptive_fusion(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.vector_outcomes(spark, folder).items
    return _exploded(fusion.adaptive_fusion(items, None, "text_emb_scaled", "img_emb_scaled"), "x")


def cross_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _exploded(fusion.cross_features(fx.vector_outcomes(spark, folder).items), "x")


def l2_normalise(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.vector_outcomes(spark, folder).items
    return _exploded(items.withColumn("x", v.l2_normalise(F.col("text_emb_scaled"))), "x")


def batch_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector, mean norm and spread of the norms, one row per modality and dimension."""
    items = fx.vector_outcomes(spark, folder).items
    row = fusion.statistics_row(items, "text_emb_scaled", "img_emb_scaled")
    both = F.array(
        *[F.struct(F.lit(name).alias("modality"), *[F.col(f"{name}_{c}").alias(c) for c in ("mean", "norm_mean", "norm_std")])
          for name in ("text", "img")]
    )
    return row.select(F.inline(both)).select(
        "modality", F.posexplode("mean").alias("pos", "mean"), "norm_mean", "norm_std"
    ).withColumns({c: F.round(c, 6) for c in ("mean", "norm_mean", "norm_std")})


def truncate_dims(spark: SparkSession, folder: str) -> DataFrame:
    """Average of a vector with one cut to a length between 1 and 60."""
    items = fx.vector_outcomes(spark, folder).items
    cut = items.withColumn(
        "img_emb", F.slice("img_emb", F.lit(1), (1 + F.col("item_id") % 60).cast("int"))
    )
    return _exploded(fusion.average_features(cut), "x")


def zero_modality(spark: SparkSession, folder: str) -> DataFrame:
    items = fx.vector_outcomes(spark, folder).items
    absent = items.withColumn("img_emb", F.when(F.col("item_id") % 3 > 0, F.col("img_emb")))
    return _exploded(fusion.average_features(absent), "x")


def text_encoder(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed word and word-pair counts of whole texts, unit length."""
    encoded = encode(
        fx.questions(spark, folder), "question", hashed_terms(32), "x", spread_by="item_id"
    )
    return _exploded(encoded, "x").where(F.col("value") > 0)


def top_words(spark: SparkSession, folder: str) -> DataFrame:
    return top_terms(fx.questions(spark, folder), "question")


def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    questions = fx.questions(spark, folder)
    weights = TfidfModel.fit(questions).weights(questions)
    return _rounded(weights, "weight")


# ---- routing policies -----------------------------------------------------


def _vectors_split(spark: SparkSession, folder: str) -> tuple[Outcomes, Column]:
    outcomes = fx.vector_outcomes(spark, folder)
    return outcomes, in_domain(outcomes.items)


def _by_label(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    outcomes, is_train = _vectors_split(spark, folder)
    models = len(outcomes.models)
    profile = written(cluster_profile(outcomes.items.where(is_train), models), "profile")
    return profile, with_profile(outcomes.items.where(~is_train), profile, profile.count(), models)


def cluster_means(spark: SparkSession, folder: str) -> DataFrame:
    profile, _ = _by_label(spark, folder)
    return profile.select(
        "cluster", F.posexplode_outer(F.arrays_zip("perf_pred", "cost_pred")).alias("model_idx", "m")
    ).select(
        "cluster", "model_idx",
        F.round("m.perf_pred", 6).alias("perf_pred"), F.round("m.cost_pred", 6).alias("cost_pred"),
    )


def cluster_route_sweep(spark: SparkSession, folder: str) -> DataFrame:
    _, test = _by_label(spark, folder)
    return _points(budget_sweep(test))


def _neighbour_sides(spark: SparkSession, folder: str, metric: str) -> tuple[NeighbourIndex, DataFrame]:
    outcomes, is_train = _vectors_split(spark, folder)
    items = fusion.average_features(outcomes.items)
    return NeighbourIndex(items.where(is_train), NEIGHBOURS, metric), items.where(~is_train)


def knn_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    index, test = _neighbour_sides(spark, folder, "cosine")
    return _rounded(index.neighbours(test), "distance")


def knn_neighbours_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The way of a train side beyond the broadcast limit, with blocks of 64 rows."""
    outcomes, is_train = _vectors_split(spark, folder)
    items = fusion.average_features(outcomes.items)
    index = NeighbourIndex(items.where(is_train), NEIGHBOURS, "cosine", broadcast=False, block_rows=64)
    return _rounded(index.neighbours(items.where(~is_train)), "distance")


def knn_neighbours_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    index, test = _neighbour_sides(spark, folder, "euclidean")
    return _rounded(index.neighbours(test), "distance")


def _predictions(predicted: DataFrame, digits: int) -> DataFrame:
    return predicted.select(
        "item_id", F.posexplode_outer(F.arrays_zip("perf_pred", "cost_pred")).alias("model_idx", "p")
    ).select(
        "item_id", "model_idx",
        F.round("p.perf_pred", 6).alias("perf_pred"), F.round("p.cost_pred", digits).alias("cost_pred"),
    )


def knn_predict(spark: SparkSession, folder: str) -> DataFrame:
    index, test = _neighbour_sides(spark, folder, "cosine")
    return _predictions(index.predict(test), 6)


def knn_sweep(spark: SparkSession, folder: str) -> DataFrame:
    index, test = _neighbour_sides(spark, folder, "cosine")
    return _points(budget_sweep(index.predict(test)))


def _moment_rows(gram: np.ndarray, spark: SparkSession) -> DataFrame:
    rows = [(i, j, float(gram[i, j])) for i in range(len(gram)) for j in range(len(gram))]
    return spark.createDataFrame(rows, "i int, j int, value double")


def moments_full(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of products of 1, all 64 features and all 8 targets over the train items."""
    outcomes, is_train = _vectors_split(spark, folder)
    items = outcomes.items.withColumn("x", F.col("text_emb").cast("array<double>"))
    return _rounded(_moment_rows(moments(items.where(is_train)).gram, spark), "value", digits=4)


def _residual_moments(spark: SparkSession, folder: str, policy, alpha: float) -> DataFrame:
    """What the normal equations leave over, per feature and target: nothing.

    Residuals are taken from the predictions of the train items; for a ridge fit the
    penalty's part goes off. Divided by the target's size, so one rounding fits all.
    """
    outcomes, is_train = _vectors_split(spark, folder)
    train = outcomes.items.withColumn("x", F.col("text_emb").cast("array<double>")).where(is_train)
    fitted = policy.fit(train)
    models = len(outcomes.models)

    def residual(pred: str, truth: str) -> Column:
        return F.zip_with(pred, F.col(truth).cast("array<double>"), lambda p, t: t - p)

    left = fitted.predict(train).select(
        "x", F.concat(residual("perf_pred", "perf"), residual("cost_pred", "cost")).alias("y")
    )
    sums = left.select(F.posexplode("x").alias("feature", "v"), "y").select(
        "feature", "v", F.posexplode("y").alias("target", "r")
    ).groupBy("feature", "target").agg(F.sum(F.col("v") * F.col("r")).alias("left_over"))
    penalty = [(i, j, float(alpha * fitted.weights[i, j])) for i in range(len(fitted.weights)) for j in range(2 * models)]
    sums = sums.join(spark.createDataFrame(penalty, "feature int, target int, pull double"), ["feature", "target"])
    size = F.when(F.col("target") < models, 1.0).otherwise(10_000.0)
    # + 0.0 turns the negative zero of a rounding into zero
    value = F.round((F.col("left_over") - F.col("pull")) / size, 6) + F.lit(0.0)
    return sums.select("feature", "target", value.alias("left_over"))


def linear_residuals(spark: SparkSession, folder: str) -> DataFrame:
    return _residual_moments(spark, folder, LinearPolicy(), 0.0)


def ridge_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """All 64 directions are kept (128 are allowed), so the low-rank fit is the ridge fit."""
    return _residual_moments(spark, folder, LowRankPolicy(), 1.0)


def _tfidf_outcomes(spark: SparkSession, folder: str, everything: bool) -> tuple[Outcomes, Column]:
    """Documents with sparse TF-IDF rows of the train texts' 20,000 terms, or of all texts'."""
    texts = fx.questions(spark, folder)
    wide = from_wide(_draw_outcomes(fx.table(spark, folder, "documents")), F.col("doc_id").cast("bigint"))
    outcomes = in_units(impute_means(wide), 10**6, 10**6)
    is_train = F.lit(True) if everything else in_domain(outcomes.items)
    train = texts.join(outcomes.items.where(is_train).select("item_id"), "item_id", "left_semi")
    vectors = TfidfModel.fit(train).sparse(texts).withColumnRenamed("doc", "item_id")
    items = outcomes.items.join(vectors.withColumnRenamed("vector", "text_emb"), "item_id")
    items = written(items.withColumn("img_emb", F.lit(None).cast("array<float>")), "tfidf-items")
    return outcomes.with_items(items), is_train


def tfidf_low_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The default policy on TF-IDF of 20,000 terms over whole documents, at full width."""
    outcomes, is_train = _tfidf_outcomes(spark, folder, everything=False)
    return _points(ev.curve("linearmf", outcomes, is_train, ev.Scales(10**6, 10**6), "11"))


def _outcome_size(models: int) -> Column:
    """Units of a target: millionths of a performance, and of a thousand of a cost."""
    return F.when(F.col("target") < models, 1e6).otherwise(1e9)


def _left_over(train: DataFrame, fitted: FittedLinear) -> tuple[DataFrame, int]:
    """Train rows ``x`` with what the predictions leave over, performances first."""
    models = len(fitted.intercept) // 2

    def residual(pred: str, truth: str) -> Column:
        return F.zip_with(pred, F.col(truth).cast("array<double>"), lambda p, t: t - p)

    left = F.concat(residual("perf_pred", "perf"), residual("cost_pred", "cost"))
    return fitted.predict(train).select("x", left.alias("r")), models


def tfidf_least_squares(spark: SparkSession, folder: str) -> DataFrame:
    """What the normal equations leave over per term and target, relative to the target's size: nothing."""
    outcomes, _ = _tfidf_outcomes(spark, folder, everything=True)
    train = outcomes.items.withColumn("x", F.col("text_emb"))
    left, models = _left_over(train, LinearPolicy().fit(train))
    rows = WideRows.of(left, F.col("r"))
    _, _, _, sums = rows.sums()  # terms x targets, like the fit itself
    cells = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(sums)], "term_idx int, target int, left_over double")
    value = F.round(F.col("left_over") / _outcome_size(models), 6) + F.lit(0.0)
    return cells.select("term_idx", "target", value.alias("left_over"))


def tfidf_ridge_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """The default policy's equations at rank 128 of 20,000: nothing is left over.

    Per direction and target what the ridge equations leave over; with target -1 by how
    much the directions, as scores of the rows, fail to be orthogonal to the later ones.
    """
    outcomes, _ = _tfidf_outcomes(spark, folder, everything=True)
    train = outcomes.items.withColumn("x", F.col("text_emb"))
    policy = LowRankPolicy()
    weights, intercept, directions = low_rank_ridge(WideRows.of(train), policy.rank, policy.alpha)
    left, models = _left_over(train, FittedLinear(weights, intercept))
    scored = WideRows.of(left.select(row_times("x", directions, left).alias("x"), "r"), F.col("r"))
    _, _, _, sums = scored.sums()
    products = np.abs(scored.gram_times(np.eye(directions.shape[1])))  # directions x directions
    equations = sums - directions.T @ weights * policy.alpha
    cells = [(i, j, float(x)) for (i, j), x in np.ndenumerate(equations)]
    cells = spark.createDataFrame(cells, "direction int, target int, left_over double")
    skew = [(i, -1, float(products[i, i + 1 :].max())) for i in range(len(products) - 1)]
    skew = spark.createDataFrame(skew, "direction int, target int, left_over double")
    rows = cells.withColumn("left_over", F.col("left_over") / _outcome_size(models)).unionByName(skew)
    return rows.select("direction", "target", (F.round("left_over", 6) + F.lit(0.0)).alias("left_over"))


def _policy_points(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        outcomes, is_train = _vectors_split(spark, folder)
        return _points(ev.curve(name, outcomes, is_train, fx.VECTOR_SCALES))

    query.__name__ = name
    return query


COMPARED = ("oracle", "random", "kmeans", "kmeansnew", "knn", "linear", "linearmf", "mlp", "mlpmf", "cmr")


def router_comparison(spark: SparkSession, folder: str) -> DataFrame:
    outcomes, is_train = _vectors_split(spark, folder)
    return _rounded(ev.compare(COMPARED, outcomes, is_train, fx.VECTOR_SCALES), "nauc", "ps", "qnc")


QUERIES = {
    "infer_long_outcomes": infer_long_outcomes,
    "impute_means": imputed_means,
    "coalesce_targets": coalesce_targets,
    "model_cost_norm": model_cost_norm,
    "single_model_baselines": single_model_baselines,
    "best_single_model": best_single,
    "csv_outcomes": csv_outcomes,
    "parquet_outcomes": parquet_outcomes,
    "merged_outcomes": merged_outcomes,
    "filter_datasets": filter_datasets,
    "union_datasets": union_datasets,
    "synthetic_outcomes": made_up_outcomes,
    "canon_names": canon_names,
    "prefix_match": prefix_match,
    "image_path_strings": image_path_strings,
    "image_path_listing": image_path_listing,
    "resolve_paths": resolve_paths,
    "split_in": split_in,
    "split_out": split_out,
    "oracle_sweep": oracle_sweep,
    "random_sweep": random_points,
    "argmax_under_budget": argmax_under_budget,
    "pareto_frontier": frontier_points,
    "trapezoid_auc": trapezoid_auc,
    "metrics_summary": metrics_summary,
    "random_metrics": random_metrics,
    "sweep_unmatched": sweep_unmatched,
    "split_out_merged": split_out_merged,
    "saved_run": saved_run,
    "budget_sweep_given_predictions": budget_sweep_given_predictions,
    "average_fusion": average_fusion,
    "adaptive_fusion": adaptive_fusion,
    "cross_fusion": cross_fusion,
    "l2_normalise": l2_normalise,
    "batch_stats": batch_stats,
    "truncate_dims": truncate_dims,
    "zero_modality": zero_modality,
    "text_encoder": text_encoder,
    "top_terms": top_words,
    "tfidf_weights": tfidf_weights,
    "cluster_profile": cluster_means,
    "cluster_route_sweep": cluster_route_sweep,
    "knn_neighbours": knn_neighbours,
    "knn_neighbours_blocks": knn_neighbours_blocks,
    "knn_neighbours_euclidean": knn_neighbours_euclidean,
    "knn_predict": knn_predict,
    "knn_sweep": knn_sweep,
    "moments_full": moments_full,
    "linear_residuals": linear_residuals,
    "ridge_residuals": ridge_residuals,
    "tfidf_linear_router": tfidf_low_rank,
    "tfidf_least_squares": tfidf_least_squares,
    "tfidf_ridge_residuals": tfidf_ridge_residuals,
    "kmeans_router": _policy_points("kmeans"),
    "kmeans_adaptive_router": _policy_points("kmeansnew"),
    "linear_router": _policy_points("linear"),
    "linear_svd_ridge_router": _policy_points("linearmf"),
    "mlp_router": _policy_points("mlp"),
    "mlp_factor_router": _policy_points("mlpmf"),
    "cross_modal_router": _policy_points("cmr"),
    "router_comparison": router_comparison,
}
