"""Registered queries against their SQL twins on the smallest tables.

The default run takes one or two queries per operator family; SCORELOOM_ALL=1 runs every query.
"""

import os

import pytest

from scoreloom.plans import load_all
from scoreloom.plans.registry import REGISTRY
from tests.harness import compare, connect

load_all()
SF = "/root/testdata/sf0.001"
DEFAULT = [
    "canon_key", "norm_option", "parse_years", "mapped_field", "classify_role", "track_name", "action_fingerprint", "state_lineage_id",
    "validate_actions", "repair_track", "classify_candidate", "advise", "classify_eligibility", "deblind", "crn_parity", "build_pool",
    "assign_sections", "nearest_event", "match_repeats", "condition_means", "rough_alpha", "eligibility_summary", "z_delta",
    "fit_calibration", "veto_share", "replay_acceptance", "budget_curve", "repeat_in_state", "recovery_rate", "budget_breach", "dedupe_last",
    "frame_rms", "short_term_levels", "moving_mean_std", "energy_boundaries", "merge_boundaries", "median_bandwidth", "mmd2_unbiased",
    "wilcoxon_signed_rank", "crossed_components", "primary_family", "shapley", "exclusion_table", "stratified_nested_sample", "histogram_draw",
    "config_drift", "read_records", "stream_telemetry", "sql_functions", "window_rows"]
NAMES = list(REGISTRY) if os.environ.get("SCORELOOM_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    if q.sql is None:
        assert df.count() > 0
        return
    assert compare(df, con.sql(q.sql)) is None
