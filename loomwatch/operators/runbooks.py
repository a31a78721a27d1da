"""Runbook eligibility: which runbook fits an incident, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwatch.operators.incidents import severity_rank

RUNBOOK = "runbook string, rule_ids array<string>, entity_kinds array<string>, evidence array<string>, floor string"


def eligibility(incidents: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Every incident with every runbook (a handful of rows by its author): eligible, and the unmet requirements in order.

    In: incidents (incident, types array, entity_kind, evidence array, severity)."""
    i = incidents.select("incident", "types", "entity_kind", F.col("evidence").alias("_have"), "severity")
    d = i.crossJoin(F.broadcast(runbooks))
    gone = F.array_except("evidence", F.coalesce("_have", F.array().cast("array<string>")))
    reasons = F.concat(
        F.array_compact(F.array(
            F.when(~F.arrays_overlap("types", "rule_ids"), "rule"),
            F.when(~F.array_contains("entity_kinds", F.col("entity_kind")), "entity"),
            F.when(severity_rank(F.col("severity")) > severity_rank(F.col("floor")), "severity"),
        )),
        F.transform(F.array_sort(gone), lambda e: F.concat(F.lit("evidence:"), e)),
    )
    return d.select("incident", "runbook", reasons.alias("missing")).withColumn("eligible", F.size("missing") == 0)


def scan(checked: DataFrame) -> DataFrame:
    """Per runbook the first eligible incident, else the one with the fewest unmet requirements."""
    order = F.struct((~F.col("eligible")).alias("a"), F.size("missing").alias("b"), F.col("incident").alias("c"))
    return checked.groupBy("runbook").agg(
        F.min_by("incident", order).alias("incident"), F.max("eligible").alias("eligible"), F.min_by("missing", order).alias("missing")
    )
