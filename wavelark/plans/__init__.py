"""Registered queries: operators on the test tables, each with its SQL check."""

from __future__ import annotations

import importlib

_MODULES = ("signal_queries", "quality_queries", "dataset_queries", "event_queries", "run_queries", "feature_queries", "model_queries", "source_queries")


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) of every module."""
    for name in _MODULES:
        importlib.import_module(f"wavelark.plans.{name}")
    from wavelark.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
