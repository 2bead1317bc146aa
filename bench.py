"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from emberfield.session import build_session  # noqa: E402

HEADLINE = [
    "agg_daily_mean", "join_left_daily", "join_left_composite", "weather_features", "weather_features_ranges", "rolling_mean_3",
    "fill_down_up", "fill_down_up_ungrouped", "ccdf", "ccdf_ranges", "scale_by_max", "median_qi", "median_qi_bracketed", "median_qi_by_order",
    "exceedance", "density_curve", "design_matrix", "gram_sums", "fit_lognormal", "fit_student", "predict_draws", "predict_packed",
    "predict_packed_hurdle", "median_qi_by_obs", "median_qi_by_obs_packed", "paired_contrast", "impact_contrast", "level_intervals",
    "ccdf_of_medians", "predicted_density", "difference_density", "bloom_exceedance", "conditional_effects",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["agg_daily_mean"](spark, folder).count()  # start-up is not part of a query
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
