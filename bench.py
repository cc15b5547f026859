"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import time

from scoreloom.plans import load_all
from scoreloom.plans.registry import REGISTRY
from scoreloom.session import build_session

HEADLINE = [
    "canon_key", "fmt_action", "validate_actions", "advise", "screen_check", "classify_eligibility",
    "pair_all_arms", "build_pool", "assign_sections", "nearest_event", "match_repeats",
    "condition_means", "win_rate_matrix", "rough_alpha", "resolution_rollup", "dynamic_range", "z_delta_summary",
    "fit_calibration", "zscore", "reward_forms", "veto_share",
    "replay_acceptance", "budget_curve", "stall_length", "repeat_in_state", "diverse_recent", "dedupe_last", "budget_breach",
    "short_term_levels", "moving_mean_std", "stem_presence", "best_excerpt",
    "song_kernel", "mmd2_unbiased", "bootstrap_ci", "frechet_distance", "similar_cases",
    "wilcoxon_signed_rank", "crossed_contrast", "crossed_components", "primary_family", "preference_rate", "metric_vs_human",
    "exclusion_table", "stratified_nested_sample", "build_prior", "config_drift", "read_records", "stream_telemetry",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    REGISTRY["stat_block"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM side
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
