"""Curves and summaries as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RUN_COLUMNS = ("router", "dataset", "mode")


def save_points(points: DataFrame, folder: str, router: str, dataset: str, mode: str) -> None:
    """Curve points as JSON lines below ``router=/dataset=/mode=``.

    Only the folder of this run is replaced.
    """
    stamped = points.withColumns(
        {"router": F.lit(router), "dataset": F.lit(dataset), "mode": F.lit(mode)}
    )
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN_COLUMNS)
        .json(folder)
    )


def save_run(folder: str, evaluation, summary: DataFrame) -> None:
    """Curve, frontier and summary of a run below ``points``, ``frontier`` and ``summary``.

    All are stamped with router, dataset and mode, which the summary names. NaN and
    infinity are written as such.
    """
    run = summary.select(*RUN_COLUMNS).first()
    for name, table in (("points", evaluation.points.drop("bucket")), ("frontier", evaluation.frontier)):
        save_points(table, f"{folder}/{name}", run["router"], run["dataset"], run["mode"])
    (
        summary.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN_COLUMNS)
        .json(f"{folder}/summary")
    )


def summary_json(summary: DataFrame) -> DataFrame:
    """One JSON text per summary; NaN and infinity are written as such."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("summary"))
