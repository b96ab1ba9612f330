"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores.
Each query runs once untimed at the smallest scale, which loads classes and
starts Python workers, then once timed over the whole tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from tablegauge.operators import profile as P  # noqa: E402
from tablegauge.plans import catalog, profile_queries  # noqa: E402
from tablegauge.session import local_session  # noqa: E402

HEADLINE = (
    "prf_01_missing", "prf_02_column_types", "prf_06_numeric_summary", "prf_10_top_values", "prf_16_duplicate_rows",
    "lkg_02_pearson", "lkg_06_strongest", "drf_06_psi", "drf_08_ks", "drf_10_chi_square", "drf_15_verdict",
    "evl_05_metrics", "evl_06_auc", "evl_07_threshold_sweep", "evl_11_per_class", "evl_16_regression_metrics",
    "src_06_log_lines", "met_04_merged_epochs", "met_09_all_findings", "run_05_verdict", "evd_04_claim_checks",
    "evd_08_unified_scores", "evd_11_cell_rates", "sta_09_contrasts", "prp_02_group_split", "prp_08_script_scan",
)
WARM_UP = "/root/testdata/sf0.001"


def full_profile(spark, folder) -> DataFrame:
    """All sixteen columns of the derived line items."""
    return P.profile(profile_queries.items(spark, folder))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    queries = {name: catalog.QUERIES[name] for name in HEADLINE} | {"prf_full_profile": full_profile}
    warm = WARM_UP if os.path.isdir(WARM_UP) else folder
    times = {}
    for name, query in queries.items():
        run(query(spark, warm))
        start = time.perf_counter()
        run(query(spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
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
