"""Investigation: timelines, indicators, assets and reach of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.intel import observed


def indicators(events: DataFrame) -> DataFrame:
    """(run_id, ioc_type, value, records, first_n, n_records): where each indicator was seen."""
    seen = observed(events, "raw", ["run_id", "n"])
    return seen.groupBy("run_id", "ioc_type", "value").agg(F.min("n").alias("first_n"), F.count_distinct("n").alias("n_records"))


def lines_to_findings(events: DataFrame, cites: DataFrame) -> DataFrame:
    """Each event with the first finding that cites its line. In: cites (run_id, finding, seq, line)."""
    first = cites.groupBy("run_id", F.col("line").alias("n")).agg(F.min_by("finding", F.struct("seq", "finding")).alias("finding"))
    return events.join(first, ["run_id", "n"], "left").withColumn("is_finding", F.col("finding").isNotNull())


def footprint(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, run_id, n): events whose text names an address or whose host is the entity, as equi-joins."""
    by_ip = observed(events, "raw", ["run_id", "n"]).filter("ioc_type = 'ipv4'").select("run_id", "n", F.col("value").alias("entity"))
    by_host = events.filter("host is not null").select("run_id", "n", F.col("host").alias("entity"))
    return by_ip.unionByName(by_host).distinct().join(entities.select("entity"), "entity", "left_semi")


def timeline(*parts: DataFrame) -> DataFrame:
    """All parts (run_id, n, us, label) once per line, by time, lines without a time last."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["run_id", "n"]).orderBy("run_id", F.col("us").asc_nulls_last(), "n")


def milestones(failures: DataFrame, successes: DataFrame, threshold: int = 5, within_us: int = 120_000_000) -> DataFrame:
    """(run_id, source, step, n, us): first failure, the one that reaches the threshold, the last, and the first success after it."""
    w = W.partitionBy("run_id", "source").orderBy("us", "n")
    k, total = F.row_number().over(w), F.count("*").over(W.partitionBy("run_id", "source"))
    d = failures.withColumn("_k", k).withColumn("_t", total).filter(F.col("_t") >= threshold)
    step: Column = F.explode(F.array_compact(F.array(F.when(F.col("_k") == 1, "first"), F.when(F.col("_k") == threshold, "threshold"), F.when(F.col("_k") == F.col("_t"), "last"))))
    marks = d.withColumn("step", step).select("run_id", "source", "step", "n", "us")
    last = marks.filter("step = 'last'").select("run_id", "source", F.col("us").alias("_last"))
    ok = successes.join(last, ["run_id", "source"]).filter(F.col("us").between(F.col("_last"), F.col("_last") + within_us))
    ok = ok.groupBy("run_id", "source").agg(F.min("n").alias("n"), F.min_by("us", "n").alias("us")).withColumn("step", F.lit("success"))
    return marks.unionByName(ok.select("run_id", "source", "step", "n", "us"))


def grounded(claims: DataFrame, text: str, facts: str) -> DataFrame:
    """Adds ungrounded: addresses in a text that are not among the finding's own, and ok."""
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(P.IOC_IP), F.lit(0))))
    d = claims.withColumn("ungrounded", F.array_except(named, F.coalesce(facts, F.array().cast("array<string>"))))
    return d.withColumn("ok", F.size("ungrounded") == 0)
