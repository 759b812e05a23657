"""Session settings, shared scratch tables and the broadcast size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Shuffle files go when the query that made them ends, not when the driver collects its garbage.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# What a broadcast side may weigh. Every caller states a bound it has proven
# (a parameter, a counted size); beyond the limit it takes a shuffled way.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", **settings: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tollgate")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster it
    would exist on one machine only.
    """
    folder = _named_folder(spark)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tollgate-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tollgate/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has written; what reads them ends to work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimiser the true size of what follows. What was shuffled for it is not needed
    after that and is deleted at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_SETTING, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave; what reads it must have ended."""
    spark = df.sparkSession
    root = _scratch_root(spark)
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if f"/tollgate/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"{folder} is not below {root}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_LIMIT_BYTES


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a join side for broadcast when its proven size allows it."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(udf):
    """Keep the optimiser from copying a costly Python function into filters."""
    return udf.asNondeterministic()
