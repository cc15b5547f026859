"""Queries over the driver tables, one per operator."""

from importlib import import_module

MODULES = ["q_scalars", "q_logs", "q_aggregates", "q_calibration", "q_rules", "q_joins", "q_series", "q_inference", "q_exclusion", "q_sets",
           "q_sampling", "q_quality", "q_vectors", "q_sources", "q_streaming", "q_udf"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"scoreloom.plans.{m}")
