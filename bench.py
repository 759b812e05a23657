"""Time the headline queries; one JSON line on stdout.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tollgate.catalog.queries import QUERIES  # noqa: E402
from tollgate.session import drop_scratch, local_session  # noqa: E402

HEADLINE = (
    "impute_means",
    "split_in",
    "oracle_sweep",
    "random_sweep",
    "budget_sweep_given_predictions",
    "pareto_frontier",
    "metrics_summary",
    "csv_outcomes",
    "adaptive_fusion",
    "text_encoder",
    "top_terms",
    "tfidf_weights",
    "kmeans_router",
    "knn_predict",
    "knn_sweep",
    "linear_router",
    "linear_svd_ridge_router",
    "mlp_router",
    "cross_modal_router",
)

# Run unmeasured first: starts the Python workers and lets the JVM compile.
WARM_UP = ("split_in", "oracle_sweep", "text_encoder")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")  # one machine: every task sees it
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds = round(time.perf_counter() - start, 3)
        drop_scratch(spark)  # the run's own tables
        return seconds

    for name in WARM_UP:
        run(name)
    names = sys.argv[1:] or HEADLINE
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
