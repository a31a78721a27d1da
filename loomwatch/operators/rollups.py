"""Counts, rollups, deltas and means over findings, incidents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.incidents import severity_rank
from loomwatch.sources.envelopes import lookup


def severity_counts(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by severity with a row for every severity, zero included, and the share in percent."""
    keys = keys or []
    spark = findings.sparkSession
    dim = spark.createDataFrame([(k, v) for k, v in P.SEVERITY_RANK.items()], "severity string, rank int")
    frame = findings.select(*keys).distinct().crossJoin(F.broadcast(dim)) if keys else dim
    n = findings.groupBy(*keys, F.upper("severity").alias("severity")).agg(F.count("*").alias("n"))
    d = frame.join(n, [*keys, "severity"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1)))
    return d.withColumn("pct", F.when(total > 0, F.bround(F.col("n") * 100.0 / total, 1)))


def per_hour(findings: DataFrame, ts: str, severity: str, values: list[str]) -> DataFrame:
    return findings.groupBy(F.date_trunc("hour", ts).alias("hour")).pivot(severity, values).agg(F.count(F.lit(1))).na.fill(0)


def frequency(items: DataFrame, array: str) -> DataFrame:
    return items.select(F.explode(array).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def risk(touches: DataFrame, keys: list[str]) -> DataFrame:
    """Per asset: touches, findings, risk (sum of severity weight times criticality weight, each rounded to one place), worst
    severity, last time. In: keys, severity (null for a plain event), criticality, us."""
    weight = lookup(P.SEVERITY_WEIGHT, F.upper("severity"), F.lit(0)) * lookup(P.CRITICALITY_WEIGHT, F.coalesce("criticality", F.lit("standard")), F.lit(1.0))
    return touches.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count("severity").alias("findings"),
        F.sum(F.when(F.col("severity").isNotNull(), F.bround(weight, 1)).otherwise(0.0)).alias("risk"),
        F.min_by(F.upper("severity"), F.when(F.col("severity").isNotNull(), severity_rank(F.col("severity")))).alias("worst"),
        F.max("us").alias("last_us"),
    )


def mean_gap(rows: DataFrame, start: Column, end: Column, keys: list[str] | None = None) -> DataFrame:
    """Mean of end - start over pairs in order, and the number of pairs; null without a pair."""
    good = end >= start
    return rows.groupBy(*(keys or [])).agg(F.avg(F.when(good, end - start)).alias("mean"), F.count_if(good).alias("pairs"))


def change(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Against the row before: previous and change in percent (half-even), null where the base is null or zero."""
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(order) if keys else W.orderBy(order))
    d = rows.withColumn("previous", prev)
    return d.withColumn("change_pct", F.when(F.col("previous") != 0, F.bround(F.abs(F.col(value) - F.col("previous")) * 100.0 / F.col("previous"), 0)))


def attempts(series: DataFrame, entity: str, order: str, value: str, last: int = 7) -> DataFrame:
    """The last runs with activity per entity: points, mean, first, latest, change and direction; null under two points."""
    w = W.partitionBy(entity).orderBy(F.desc(order))
    recent = series.filter(F.col(value) > 0).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last)
    per = recent.groupBy(entity).agg(
        F.count("*").alias("points"), F.avg(value).alias("mean"), F.max_by(value, "_k").alias("first"), F.min_by(value, "_k").alias("latest")
    )
    enough = F.col("points") >= 2
    return per.withColumn("change", F.when(enough, F.col("latest") - F.col("first"))).withColumn(
        "direction", F.when(~enough, None).when(F.col("latest") > F.col("first"), "up").when(F.col("latest") < F.col("first"), "down").otherwise("flat")
    )


def runs_summary(findings: DataFrame, run: str, measures: dict[str, Column]) -> DataFrame:
    """A row per run and one for all runs (run is null there)."""
    return findings.rollup(run).agg(*(c.alias(n) for n, c in measures.items()))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, newest first as ``order`` says; the limit is held to 1..1000."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def store_query(rows: DataFrame, exact: dict[str, str], text: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Exact filters on known columns and free text in any of ``columns``, whatever the case."""
    for k, v in exact.items():
        if k in rows.columns:
            rows = rows.filter(F.col(k) == v)
    if text:
        any_ = F.lit(False)
        for c in columns or []:
            any_ = any_ | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
        rows = rows.filter(any_)
    return rows


def run_header(findings: DataFrame) -> DataFrame:
    """Per run: time window, hosts that were derived from lines, rule and model counts."""
    return findings.groupBy("run_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.array_sort(F.collect_set(F.when(F.col("host_derived"), F.col("host")))).alias("hosts"),
        F.count_if(F.col("source") == "model").alias("model"), F.count_if(F.col("source") != "model").alias("rules"),
    )
