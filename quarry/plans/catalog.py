"""Imports every catalog module so that all queries are registered."""

from __future__ import annotations

import importlib

from quarry.plans.registry import REGISTRY

MODULES = [
    "quarry.plans.catalog_templates",
    "quarry.plans.catalog_analysis",
    "quarry.plans.catalog_profile",
    "quarry.plans.catalog_quality",
    "quarry.plans.catalog_sources",
    "quarry.plans.catalog_logs",
    "quarry.plans.catalog_reconcile",
    "quarry.plans.catalog_questions",
    "quarry.plans.catalog_streaming",
]

for _m in MODULES:
    importlib.import_module(_m)

__all__ = ["REGISTRY"]
