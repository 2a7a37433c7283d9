"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated
list of name prefixes (default: the headline list; "all" for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from florapark.plans.catalog import QUERIES  # noqa: E402
from florapark.session import local_session  # noqa: E402

HEADLINE = [
    "k3_stratified_report", "m5_compute_metrics", "m9_confusion", "m11_per_split_metrics", "k7_moving_window_grid",
    "e1_seed_summary", "e2_macro_over_seeds", "s10_species_index", "s18_prediction_table",
    "f7_flag_duplicates", "f8_near_reference", "f9_seas_urban", "f21_dedupe_species_location", "f26_mask_labels",
    "t4_match_fuzzy", "t8_map_back", "g4_aggregate_presence", "g6_snap_to_reference_grid", "g10_unique_locations",
    "g13_assign_area", "g15_range_mask_by_location", "g16_range_mask_by_species", "g18_range_size", "g22_fill_nodata_nearest",
    "g24_nearest_background", "g29_rescale_linear", "g29_rescale_rank", "p2_cap_per_species", "p4_presence_background",
    "p7_stratified_split", "r6_sampling_properties", "r8_species_percentiles", "x6_maxent_hinges", "x10_loss_denominators",
    "x12_weighted_bce", "l9_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    if wanted == "all":
        names = list(QUERIES)
    elif wanted:
        names = [n for n in QUERIES if n.startswith(tuple(wanted.split(",")))]
    else:
        names = HEADLINE
    spark = local_session(cpus, "florapark-bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    # one warm-up, so that starting the engine is not counted for the first query
    QUERIES["f26_mask_labels"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name:34s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
