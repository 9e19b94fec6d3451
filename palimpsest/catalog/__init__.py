"""Registered queries and their oracle SQL, grouped by area."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AREAS = [
    "search_queries", "tier_queries", "text_queries", "event_queries", "recall_queries",
    "store_queries", "diagnose_queries", "block_queries", "panel_queries",
    "live_queries", "report_queries", "history_queries",
]


class Registry:
    """Collects ``name -> (query, oracle)`` pairs of one area."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return keep


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for area in AREAS:
        out.update(import_module(f"palimpsest.catalog.{area}").registry.queries)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for area in AREAS:
        out.update(import_module(f"palimpsest.catalog.{area}").registry.oracles)
    return out
