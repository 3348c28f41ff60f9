"""Ready-made jobs and named queries."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("text_policy", "network", "behaviour", "monitoring", "observation")


def all_queries() -> dict:
    from clausetrail.plans.registry import QUERIES

    for group in GROUPS:
        import_module(f"clausetrail.plans.{group}")
    return dict(QUERIES)
