"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "label_reasons_by_day", "trailing_features", "score_signals", "continuity", "asof_backward", "endpoint_join", "horizon_rates",
    "case_state", "study_funnel", "grid_search", "cluster_bootstrap", "match_nearest", "match_same_cycle", "screening_verdict",
    "check_concentration", "linked_exposure", "reconcile_endpoints", "level_cross", "movement_alarm", "nonoverlapping_episodes",
    "verify_chain", "hash_sample_by_stratum", "distribution", "bucket_snapshots"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from marketlens import plans

    names = only.split(",") if only else HEADLINE
    warm = plans.QUERIES["label_reasons_by_day"](spark, sf)
    warm.write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
