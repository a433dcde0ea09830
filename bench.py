"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from placegrid.plans import reference
from placegrid.session import session

HEADLINE = ("knn_topk_l2", "knn_chunked_merge", "aqe_knn", "success_rate", "radius_gt", "geo_success", "batch_clean_report", "patch_grid", "grid_map_bilinear", "gem_weighted", "alpha_sweep", "resume_pending", "upsert_latest", "usage_rollup", "rate_audit")


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    run, took = reference.queries(), {}
    run["success_rate"](spark, sf).collect()  # warm-up
    for name in HEADLINE:
        began = time.time()
        run[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
