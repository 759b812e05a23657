"""Outcome tables from CSV or Parquet."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollgate.functions import names as n
from tollgate.operators.outcomes import Outcomes, check_columns, from_wide


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def dataset_list(spec: str | Sequence[str]) -> list[str]:
    """``a+b+c`` as names; blanks around them and empty ones are dropped."""
    parts = spec.split("+") if isinstance(spec, str) else spec
    return [p.strip() for p in parts if p.strip()]


def read_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV or Parquet outcome table (one file, or a folder of part files).

    CSV cells stay text, so no pass is spent on guessing types. Quoted line
    breaks need ``multi_line``, which reads every file in one task; a large table
    belongs in many part files or in Parquet.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no outcome table at {path}")
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(path)`` of the images below ``folder``; their contents are not read.

    Spark leaves empty files out of a scan, so they count as absent.
    """
    endings = ",".join(e.removeprefix(".") for e in n.IMAGE_ENDINGS)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{{{endings}}}")
        .load(folder)
    )
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def with_listed_images(
    df: DataFrame, idx: str, root: str, listing: DataFrame, prefixes: Mapping[str, str] = n.PREFIX_FOLDERS
) -> DataFrame:
    """Set ``img_path`` from the instance id: the first listed ending, else ``.jpg``."""
    ending = F.regexp_extract("path", r"\.[^./]*$", 0)
    rank = F.array_position(F.lit(list(n.IMAGE_ENDINGS)), ending)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    found = (
        listing.withColumns({"_rank": rank, "_stem": stem})
        .where(F.col("_rank") > 0)
        .groupBy("_stem")
        .agg(F.min_by("path", "_rank").alias("_found"))
    )
    named = df.withColumn("_default", n.default_image_path(F.col(idx), root, prefixes))
    known = named.where(F.col("_default") != "").withColumn(
        "_stem", F.regexp_replace("_default", r"\.jpg$", "")
    )
    joined = known.join(found, "_stem", "left").withColumn(
        "img_path", F.coalesce("_found", "_default")
    )
    # rows of unknown data sets match nothing; joined, they would share one key
    unknown = named.where(F.col("_default") == "").withColumn("img_path", F.lit(""))
    return joined.drop("_default", "_stem", "_found").unionByName(unknown.drop("_default"))


def backfilled_paths(
    df: DataFrame,
    root: str,
    listing: DataFrame | Callable[[], DataFrame] | None = None,
    prefixes: Mapping[str, str] = n.PREFIX_FOLDERS,
) -> DataFrame:
    """Derive ``img_path`` from ``dataset_idx`` where the column is absent or
    wholly empty; without ids it becomes empty. A listing given as a function is
    only made when paths are to be derived."""
    if "img_path" in df.columns:
        known = df.where(F.col("img_path").isNotNull() & (F.col("img_path") != ""))
        if known.select("img_path").first() is not None:
            return df
        df = df.drop("img_path")
    if "dataset_idx" not in df.columns:
        return df.withColumn("img_path", F.lit(""))
    if listing is not None:
        listing = listing() if callable(listing) else listing
        return with_listed_images(df, "dataset_idx", root, listing, prefixes)
    return df.withColumn("img_path", n.default_image_path(F.col("dataset_idx"), root, prefixes))


def read_dataset(spark: SparkSession, root: str, name: str, ending: str = ".csv", multi_line: bool = True) -> DataFrame:
    """``<root>/<name><ending>`` stamped with its name, image paths resolved
    against the image folder ``<root>/<name>`` if there is one, else the root."""
    df = read_table(spark, f"{root}/{name}{ending}", multi_line).withColumn("dataset", F.lit(name))
    if "img_path" in df.columns:
        base = f"{root}/{name}" if path_exists(spark, f"{root}/{name}") else root
        df = df.withColumn("img_path", n.resolve_path(F.col("img_path"), F.lit(base)))
    return df


def wanted_prefixes(datasets: Sequence[str], prefixes: Mapping[str, str] = n.PREFIX_FOLDERS) -> list[str] | None:
    """Prefixes of the named data sets, or None if one of them is not known."""
    aliases = n.alias_table(prefixes)
    found = [aliases.get(n.canonical_name(d)) for d in datasets]
    return None if None in found else sorted(set(found))


def from_merged(
    merged: DataFrame, datasets: Sequence[str], prefixes: Mapping[str, str] = n.PREFIX_FOLDERS
) -> DataFrame:
    """Rows of the named data sets out of a merged table, stamped with their folder."""
    if "dataset_idx" not in merged.columns:
        raise ValueError("a merged outcome table needs a 'dataset_idx' column")
    wanted = wanted_prefixes(datasets, prefixes)
    if wanted is None:
        raise ValueError("a merged outcome table holds known data sets only")
    idx = F.col("dataset_idx")
    return merged.where(n.longest_prefix(idx, prefixes).isin(*wanted)).withColumn(
        "dataset", n.folder_of(idx, prefixes)
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column a table lacks is missing there."""
    if not frames:
        raise ValueError("no data sets named")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_outcomes(
    spark: SparkSession,
    root: str,
    datasets: str | Sequence[str],
    merged_name: str | None = None,
    ending: str = ".csv",
    prefixes: Mapping[str, str] = n.PREFIX_FOLDERS,
    multi_line: bool = True,
    list_images: bool = True,
    item_id: Column | None = None,
) -> Outcomes:
    """Outcomes of the named data sets below ``root``.

    The merged table ``<root>/<merged_name>`` is read if it exists and knows all
    the names; otherwise ``<root>/<name><ending>`` of every name in lower case.
    """
    root = root.rstrip("/")
    wanted = dataset_list(datasets)
    use_merged = (
        merged_name is not None
        and wanted_prefixes(wanted, prefixes) is not None
        and path_exists(spark, f"{root}/{merged_name}")
    )
    if use_merged:
        wide = from_merged(read_table(spark, f"{root}/{merged_name}", multi_line), wanted, prefixes)
    else:
        wide = union_by_name(
            [read_dataset(spark, root, name.lower(), ending, multi_line) for name in wanted]
        )
    check_columns(wide.columns)
    listing = (lambda: image_listing(spark, root)) if list_images else None
    return from_wide(backfilled_paths(wide, root, listing, prefixes), item_id)
