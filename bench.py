"""Headline queries over the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dustspark.plans.catalog import CATALOG  # noqa: E402
from dustspark.session import build_session  # noqa: E402

HEADLINE = [
    "cheapest_cleaning_interval", "w5_training_samples", "w11_segmented_mass", "a16_best_policy",
    "a13_schedule_totals", "f1_mass_balance", "f5_site_factor_calibration", "a1_rollup_serving", "j9_nearest_site",
    "j12_newest_imagery", "b3_bm25_search", "x25_word_chunks", "s9_html_text", "m12_roc_auc",
    "m14_threshold_sweep", "a20_feature_ranges", "q1_site_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # JVM warm-up
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
