"""

Every budget is tried on the whole item x model matrix. On the orders a full run
takes hours, so the time per budget is measured and multiplied.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tollgate.catalog import fixtures as fx  # noqa: E402
from tollgate.session import local_session  # noqa: E402


def one_budget(budget, perf_pred, cost_pred, perf, cost, rows):
    choice = np.where(cost_pred <= budget, perf_pred, -np.inf).argmax(axis=1)
    return cost[rows, choice].mean(), perf[rows, choice].mean()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    items = fx.order_units(spark, folder).items.select("perf", "cost").toPandas()
    perf, cost = np.vstack(items["perf"]).astype(float), np.vstack(items["cost"]).astype(float)
    rows, budgets = np.arange(len(perf)), np.unique(cost)
    tried = budgets[:: max(1, len(budgets) // 50)]
    start = time.perf_counter()
    for budget in tried:
        one_budget(budget, perf, cost, perf, cost, rows)
    each = (time.perf_counter() - start) / len(tried)
    print(
        json.dumps(
            {
                "items": len(perf),
                "models": perf.shape[1],
                "budgets": len(budgets),
                "seconds_per_budget": round(each, 6),
                "seconds_for_all_budgets": round(each * len(budgets), 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
