"""All registered queries."""

from __future__ import annotations

import importlib

from pagelens.plans.registry import CASES

MODULES = ["spatial", "blocks", "codes", "catalog", "drawing", "raster", "streams"]


def all_cases():
    for name in MODULES:
        importlib.import_module(f"pagelens.plans.cases_{name}")
    return CASES
