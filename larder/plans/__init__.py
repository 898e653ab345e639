"""Registered queries, grouped by the kind of work they do."""

from __future__ import annotations

import importlib

MODULES = ["scans", "filters", "search", "mealplans", "joins", "aggregates", "text", "values", "streams", "extension", "recipe_lists"]


def load_all():
    from larder.plans.registry import QUERIES

    for name in MODULES:
        importlib.import_module(f"larder.plans.{name}")
    return QUERIES
