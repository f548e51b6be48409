"""Registry of the core queries: name -> callable(spark, sf_dir), and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import graph, shredding, sitefiles, sitemaps, snapshots
from .plans import checks, fetch_log, history, pages, report, runs, signals
from .sources import tables
from .streaming import windows

_PLANS = (pages, checks, report, runs, history, fetch_log, signals, graph, sitefiles, sitemaps, tables, windows)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "p5_found": snapshots.found,
        "p6_found": shredding.found,
        "p6_signal_table": shredding.signal_table,
    }
    for plan in _PLANS:
        out |= plan.registry()[0]
    return out


def oracle_sql() -> dict[str, str]:
    out = {"p5_found": snapshots.FOUND_SQL, "p6_found": shredding.FOUND_SQL, "p6_signal_table": shredding.SIGNAL_TABLE_SQL}
    for plan in _PLANS:
        out |= plan.registry()[1]
    return out
