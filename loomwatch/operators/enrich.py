"""Context for findings: sprayed names, hydrated evidence, hosts, predicates, technique chains, cases, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.incidents import severity_rank
from loomwatch.sources.envelopes import lookup, part


def username_spray(records: DataFrame, shown: int = 4) -> DataFrame:
    """(run_id, source, distinct_usernames, sample): names tried per address, in order of first appearance."""
    msg = F.col("msg")
    d = records.filter(msg.rlike(P.AUTH_FAIL)).select("run_id", "n", part(P.AUTH_FAIL, 2, msg).alias("source"), part(P.AUTH_FAIL, 1, msg).alias("user"))
    first = d.groupBy("run_id", "source", "user").agg(F.min("n").alias("n"))
    k = F.row_number().over(W.partitionBy("run_id", "source").orderBy("n", "user"))
    ranked = first.withColumn("_k", k)
    return ranked.groupBy("run_id", "source").agg(
        F.count("*").alias("distinct_usernames"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= shown, F.struct("_k", "user")))), lambda x: x["user"]).alias("sample")
    )


def hydrate(cites: DataFrame, events: DataFrame, limit: int = 50) -> DataFrame:
    """Each finding with its cited lines verbatim, in file order, and the host of the first line that has one."""
    k = F.row_number().over(W.partitionBy("run_id", "finding").orderBy("line"))
    some = cites.select("run_id", "finding", "line").distinct().withColumn("_k", k).filter(F.col("_k") <= limit)
    j = some.join(events.select("run_id", F.col("n").alias("line"), "raw", "host"), ["run_id", "line"])
    return j.groupBy("run_id", "finding").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]).alias("evidence"),
        F.min_by("host", F.when(F.col("host").isNotNull(), F.col("line"))).alias("host"),
    )


def around(text: Column, entity: Column) -> Column:
    """The text split around an entity: before, match, after; without the entity all of it is before."""
    at = F.instr(text, entity)
    cut = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), entity.alias("match"), F.substring(text, at + F.length(entity), F.length(text)).alias("after"))
    whole = F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after"))
    return F.when(at > 0, cut).otherwise(whole)


def predicates(failures: int = 5, window_s: int = 120, burst: int = 5, burst_s: int = 60) -> dict[str, str]:
    """What each rule asks for, in the thresholds that it runs with."""
    return {
        "auth_bruteforce": f"at least {failures} failures from one source; high when {failures} fall within {window_s} s",
        "auth_bruteforce_success": f"a success from the same source within {window_s} s of its last failure",
        "error_rate_spike": f"at least {burst} ERROR or CRIT lines within {burst_s} s",
        "disk_pressure": f"disk usage of {P.DISK_WARN} % or more; high from {P.DISK_CRIT} %",
        "suspicious_outbound": f"a connection to one of the ports {', '.join(map(str, P.SUSPICIOUS_PORTS))}",
        "critical_service_event": "a line at CRIT level",
        "possible_break_in": "a reverse-DNS mismatch reported by the daemon",
    } | {kind: f"event id {', '.join(i for i, v in P.WINDOWS_EVENTS.items() if v[1] == kind)}: {sev}" for sev, kind in dict.fromkeys(P.WINDOWS_EVENTS.values())}


def with_predicate(findings: DataFrame, **thresholds) -> DataFrame:
    """Adds predicate; the threat and infrastructure families by their prefix, null for a type without one."""
    kind = F.col("type")
    family = F.when(kind.startswith("threat_"), "a registered threat pattern matched").when(kind.startswith("infra_"), "an infrastructure pattern matched or the vendor gave a severity")
    return findings.withColumn("predicate", F.coalesce(lookup(predicates(**thresholds), kind), family))


def technique_chain(matches: DataFrame, links: DataFrame, techniques: DataFrame) -> DataFrame:
    """Matches with the techniques that their indicator points to; none gives an empty array."""
    pairs = links.select("indicator", F.explode("techniques").alias("stix_id")).join(techniques.select("stix_id", "technique_id", "name"), "stix_id")
    lists = pairs.groupBy("indicator").agg(F.array_sort(F.collect_set(F.struct("technique_id", "name"))).alias("chain"))
    empty = F.array().cast("array<struct<technique_id:string,name:string>>")
    return matches.join(lists, "indicator", "left").withColumn("chain", F.coalesce("chain", empty))


def restated(model: DataFrame, detector: DataFrame) -> DataFrame:
    """Model findings that do not merely restate a detector finding of the run: no shared address, port or line marker."""
    d = detector.select("run_id", F.explode("markers").alias("marker")).distinct()
    hit = model.select("run_id", "id", F.explode("markers").alias("marker")).join(d, ["run_id", "marker"]).select("run_id", "id").distinct()
    return model.join(hit, ["run_id", "id"], "left_anti")


def attach_cases(incidents: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidents with their cases, links to unknown incidents, incidents that need a new case)."""
    links = cases.select("case_id", F.explode("incident_ids").alias("incident_id"))
    per = links.groupBy("incident_id").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    with_cases = incidents.join(per, "incident_id", "left")
    orphans = links.join(incidents.select("incident_id"), "incident_id", "left_anti")
    fresh = incidents.join(links.select("incident_id"), "incident_id", "left_anti")
    if "origin" in incidents.columns:
        fresh = fresh.filter(~F.coalesce(F.col("origin") == "manual", F.lit(False)))
    return with_cases, orphans, fresh


def findings_page(findings: DataFrame, severity: str | None = None, rule: str | None = None, host: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page in order of severity, and (total, truncated)."""
    d = findings
    if severity:
        d = d.filter(F.upper("severity") == severity.upper())
    if rule:
        d = d.filter(F.lower("type").contains(rule.lower()))
    if host:
        d = d.filter(F.lower("host").contains(host.lower()))
    total = d.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > limit)
    return d.orderBy(severity_rank(F.col("severity")), "seq").limit(limit), total


def dashboard(findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row of counts over the tables."""
    f = findings.agg(F.count("*").alias("findings"), F.count_if(severity_rank(F.col("severity")) <= 1).alias("urgent"), F.count_distinct("host").alias("hosts"))
    i = incidents.agg(F.count("*").alias("incidents"), F.count_if(F.upper("severity") == "CRITICAL").alias("critical_incidents"))
    return f.crossJoin(i)  # one row each


def kill_chain(observed: DataFrame) -> DataFrame:
    """The four phases with how often each was seen and whether it lies ahead of the deepest one. In: (tactic)."""
    spark = observed.sparkSession
    dim = spark.createDataFrame(list(enumerate(P.PHASES)), "ordinal int, phase string")
    n = observed.select(lookup(P.TACTIC_PHASE, F.col("tactic")).alias("ordinal")).filter("ordinal is not null").groupBy("ordinal").agg(F.count("*").alias("n"))
    d = dim.join(n, "ordinal", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    deepest = d.filter("n > 0").agg(F.max("ordinal").alias("_d"))
    return d.crossJoin(F.broadcast(deepest)).select("ordinal", "phase", "n", (F.col("ordinal") > F.coalesce("_d", F.lit(-1))).alias("ahead"))


def reach(footprint_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Per entity: hosts touched, records, first and last line."""
    j = footprint_rows.join(events.select("run_id", "n", "host"), ["run_id", "n"])
    return j.groupBy("entity").agg(F.array_sort(F.collect_set("host")).alias("assets"), F.count("*").alias("records"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))
