"""Registered queries: operators applied to the given tables, with oracle SQL."""

from __future__ import annotations

import importlib

MODULES = (
    "returns", "metrics", "inference", "chain", "covariance", "audit", "selection", "quotes",
    "validation", "reconcile", "decisions",
)


def catalog():
    """All registered queries by name."""

    for module in MODULES:
        importlib.import_module(f"premia.plans.{module}")
    from premia.plans.registry import CATALOG

    return CATALOG
