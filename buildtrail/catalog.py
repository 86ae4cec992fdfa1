"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from buildtrail.plans import builds, covers, fleet, graph, sources, stages, stateful, store, telemetry, timers, windows

MODULES = [telemetry, graph, fleet, store, windows, builds, stages, sources, stateful, covers, timers]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found
