"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pagelens.plans.fixtures import Tables

CASES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def case(name: str, sql: str | None = None):
    """Register a query under an operator id, with its DuckDB oracle where one exists."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in CASES:
            raise ValueError(f"duplicate case {name}")
        CASES[name] = (build, sql)
        return build

    return add
