"""Every query of the library with its DuckDB counterpart, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwatch.plans import console, context, detection, enrichment, evidence, incident, ingest, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (detection, incident, ingest, context, console, enrichment, evidence, stream):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
