"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from premia.plans import catalog  # noqa: E402
from premia.session import local_session  # noqa: E402

HEADLINE = (
    "perf_summary", "perf_metrics", "wealth_path", "var_cvar_95", "psr", "bootstrap_ci",
    "bs_greeks", "reprice_chain", "risk_exposures", "option_return",
    "joint_moments", "option_covariance", "book_volatility",
    "scenario_cross", "scenario_cvar", "portfolio_audit", "integer_or_cash",
    "select_candidate", "asof_entry_quote", "quote_coverage", "spread_quantiles",
    "cpcv_paths", "pbo", "file_manifest", "summary_reconcile",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    # One untimed pass over a small query starts the session and its code paths.
    queries["ann_mean"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
