"""Experiment analytics on Spark: score tables, proposal logs, ratings, questionnaires, vectors, frames."""

from scoreloom.session import build_session, scratch_path, shared_dir

__all__ = ["build_session", "scratch_path", "shared_dir"]
