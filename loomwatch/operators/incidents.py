"""From findings to incidents: entities, techniques, sessions, priority, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.sources.envelopes import lookup

GAP_US = 1_800_000_000


def severity_rank(sev: Column) -> Column:
    return lookup(P.SEVERITY_RANK, F.upper(sev), F.lit(5))


def with_techniques(findings: DataFrame, table: dict[str, tuple[str, str, str]] = P.TECHNIQUES) -> DataFrame:
    """Adds technique_id, technique, tactic by finding type (left join on a table of rules, sized by its author)."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(k, *v) for k, v in table.items()], "type string, technique_id string, technique string, tactic string")
    return findings.join(F.broadcast(dim), "type", "left")


def sessions(findings: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Adds cluster: findings of one entity no more than the gap apart, counted from 0. Those without a time join the first
    cluster. In: (run_id, entity, us, seq)."""
    w = W.partitionBy("run_id", "entity").orderBy(F.col("us").asc_nulls_first(), "seq")
    new = F.coalesce(F.col("us") - F.lag("us").over(w) > gap_us, F.lit(False)).cast("int")
    return findings.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def rolled_up(clustered: DataFrame) -> DataFrame:
    """Single low or informational findings of an entity merge into one cluster (-1) when there are several."""
    one = F.count("*").over(W.partitionBy("run_id", "entity", "cluster")) == 1
    minor = one & F.upper("severity").isin("LOW", "INFO")
    d = clustered.withColumn("_minor", minor.cast("int"))
    many = F.sum("_minor").over(W.partitionBy("run_id", "entity")) > 1
    return d.withColumn("cluster", F.when((F.col("_minor") == 1) & many, -1).otherwise(F.col("cluster"))).drop("_minor")


def incidents(clustered: DataFrame) -> DataFrame:
    """One row per cluster: severity (worst), size, times, finding ids, types, deterministic id."""
    worst = F.min_by(F.upper("severity"), severity_rank(F.col("severity")))
    per = clustered.groupBy("run_id", "entity", "cluster").agg(
        worst.alias("severity"), F.count("*").alias("findings"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("finding_ids"), F.array_sort(F.collect_set("type")).alias("types"),
    )
    ids = F.substring(F.sha1(F.array_join("finding_ids", ",")), 1, 8)
    text = F.concat_ws("|", "run_id", F.col("entity").cast("string"), F.coalesce(F.col("first_us").cast("string"), F.lit("no-stamp")), ids)
    return per.withColumn("incident_id", F.concat(F.lit("inc-"), F.substring(F.sha1(text), 1, 12)))


def phase(tactics: Column) -> Column:
    """The deepest phase among an array of tactics; empty text if none is known."""
    ordinal = F.array_max(F.transform(tactics, lambda t: lookup(P.TACTIC_PHASE, t)))
    return F.coalesce(lookup(dict(enumerate(P.PHASES)), ordinal), F.lit(""))


def priority(incidents_: DataFrame, severity: str = "severity", criticality: str = "criticality") -> DataFrame:
    """Adds priority from the (severity, criticality) matrix; an untagged asset is standard."""
    spark = incidents_.sparkSession
    dim = spark.createDataFrame([(s, c, p) for (s, c), p in P.PRIORITY.items()], "_s string, _c string, priority string")
    crit = F.coalesce(criticality, F.lit("standard"))
    return incidents_.join(F.broadcast(dim), (F.upper(severity) == F.col("_s")) & (crit == F.col("_c")), "left").drop("_s", "_c")


def merge_stored(derived: DataFrame, stored: DataFrame, kept: list[str], key: str = "incident_id") -> DataFrame:
    """Derived incidents with the analyst's columns of the stored ones; stored ones that are not derived any more stay."""
    both = derived.select(key, *(c for c in derived.columns if c != key and c not in kept), F.lit(True).alias("_d")).join(
        stored.select(key, *(F.col(c).alias(f"_s_{c}") for c in stored.columns if c != key)), key, "full_outer"
    )
    cols = [c for c in derived.columns if c != key and c not in kept]
    prev = lambda c: F.col(f"_s_{c}") if c in stored.columns else F.lit(None)
    return both.select(key, *(F.when(F.col("_d"), F.col(c)).otherwise(prev(c)).alias(c) for c in cols), *(prev(c).alias(c) for c in kept))
