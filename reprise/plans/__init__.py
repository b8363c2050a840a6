"""Registered queries, grouped by theme."""

from importlib import import_module

MODULES = ["core_queries", "score_queries", "visit_queries", "retention_queries", "identity_queries", "quality_queries", "channel_queries", "check_queries", "model_queries", "level_queries"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"reprise.plans.{m}")
