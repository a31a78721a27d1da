"""Deterministic rules: records in, anomalies out. Anomalies of all rules have one shape and are united in pass order."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators import auth
from loomwatch.sources.envelopes import lookup, part

ANOMALY = ["run_id", "pass_no", "seq", "severity", "type", "summary", "evidence", "entity", "occurrences"]


def found(df: DataFrame, pass_no: int, severity: Column, kind: Column, summary: Column, evidence: Column, entity: Column, seq: Column, occurrences: Column | None = None) -> DataFrame:
    return df.select(
        "run_id", F.lit(pass_no).alias("pass_no"), seq.cast("long").alias("seq"), severity.alias("severity"), kind.alias("type"),
        summary.alias("summary"), evidence.alias("evidence"), entity.alias("entity"),
        (F.lit(1) if occurrences is None else occurrences).cast("long").alias("occurrences"),
    )


def auth_bruteforce(records: DataFrame) -> DataFrame:
    msg = F.col("msg")
    us = F.unix_micros("ts")
    fails = records.filter(msg.rlike(P.AUTH_FAIL)).select("run_id", part(P.AUTH_FAIL, 2, msg).alias("source"), part(P.AUTH_FAIL, 1, msg).alias("user"), "n", us.alias("us"))
    oks = records.filter(msg.rlike(P.AUTH_OK)).select("run_id", part(P.AUTH_OK, 2, msg).alias("source"), "n", us.alias("us"))
    hits = auth.bruteforce(fails, oks)
    kind = F.when(F.col("severity") == "critical", "auth_bruteforce_success").otherwise("auth_bruteforce")
    text = F.format_string("%d failed logins from %s", "failures", "source")
    lines = F.format_string("lines %d-%d", "first_n", "last_n")
    return found(hits, 0, F.col("severity"), kind, text, lines, F.col("source"), F.col("first_n"), F.col("failures"))


def suspicious_outbound(records: DataFrame) -> DataFrame:
    port = F.regexp_extract("msg", P.DESTINATION, 2).cast("int")
    d = records.filter(F.col("msg").rlike(P.DESTINATION)).withColumn("_port", port).filter(F.col("_port").isin(list(P.SUSPICIOUS_PORTS)))
    ip = part(P.DESTINATION, 1, F.col("msg"))
    word = F.when(F.lower("msg").contains("block"), "blocked").otherwise("ALLOWED")
    text = F.format_string("Outbound connection to %s:%d (%s)", ip, "_port", word)
    return found(d, 1, F.lit("high"), F.lit("suspicious_outbound"), text, F.col("raw"), ip, F.col("n"))


def critical_events(records: DataFrame) -> DataFrame:
    d = records.filter(F.upper("level").isin("CRIT", "CRITICAL"))
    sev = F.when(F.lower("msg").rlike("exhaust|pool|down"), "critical").otherwise("high")
    text = F.concat(F.lit("Critical event on "), F.coalesce("host", F.lit("unknown")), F.lit(": "), F.substring("msg", 1, 80))
    return found(d, 2, sev, F.lit("critical_service_event"), text, F.col("raw"), F.col("host"), F.col("n"))


def disk_pressure(records: DataFrame) -> DataFrame:
    pct = F.regexp_extract("msg", P.DISK_USAGE, 1).cast("int")
    d = records.filter(F.col("msg").rlike(P.DISK_USAGE)).withColumn("_pct", pct).filter(F.col("_pct") >= P.DISK_WARN)
    sev = F.when(F.col("_pct") >= P.DISK_CRIT, "high").otherwise("medium")
    text = F.format_string("Disk usage at %d%% on %s", "_pct", F.coalesce("host", F.lit("unknown")))
    return found(d, 2, sev, F.lit("disk_pressure"), text, F.col("raw"), F.col("host"), F.col("n"))


def error_bursts(events: DataFrame, window_us: int = 60_000_000, least: int = 5) -> DataFrame:
    """(run_id, start_n, end_n, count): forward windows with enough events, picked greedily without overlap of line numbers.

    In: (run_id, n, us). Every event also visits the time buckets beside its own, so that a bucket, never a run, is what a window
    sorts. Windows never cross a gap longer than themselves; such islands are numbered by prefix sums over blocks of buckets and
    folded alone."""
    own = F.floor(F.col("us") / window_us)
    e = events.filter("us is not null").select("run_id", "n", "us", own.alias("_own"), F.explode(F.array(own - 1, own, own + 1)).alias("_b"))
    bucket = W.partitionBy("run_id", "_b")
    ahead = bucket.orderBy("us").rangeBetween(0, window_us)
    peers = W.partitionBy("run_id", "_b", "us").orderBy("n")
    d = e.withColumn("_before", F.row_number().over(peers) - 1)
    d = d.withColumn("count", F.count("*").over(ahead) - F.col("_before"))
    d = d.withColumn("end_n", F.max_by("n", F.struct("us", "n")).over(ahead))
    d = d.withColumn("_new", F.coalesce(F.col("us") - F.lag("us").over(bucket.orderBy("us", "n")) > window_us, F.lit(True)).cast("int"))
    d = d.filter("_b = _own").withColumn("_block", F.floor(F.col("_own") / 1000))
    starts = d.groupBy("run_id", "_block").agg(F.sum("_new").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy("run_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_new").over(W.partitionBy("run_id", "_block").orderBy("us", "n"))
    d = d.withColumn("_inside", inside).join(starts.withColumn("_base", before).drop("_s"), ["run_id", "_block"])
    d = d.withColumn("_island", F.col("_base") + F.col("_inside")).filter(F.col("count") >= least)
    per = d.groupBy("run_id", "_island").agg(F.array_sort(F.collect_list(F.struct("us", "n", "end_n", "count"))).alias("_c"))
    zero = F.struct(F.lit(None).cast("long").alias("upto"), F.array().cast("array<struct<us:bigint,n:bigint,end_n:bigint,count:bigint>>").alias("got"))

    def step(acc, x):
        free = acc["upto"].isNull() | (x["n"] > acc["upto"])
        return F.when(free, F.struct(x["end_n"].alias("upto"), F.array_append(acc["got"], x).alias("got"))).otherwise(acc)

    picked = per.select("run_id", F.explode(F.aggregate("_c", zero, step, lambda a: a["got"])).alias("x"))
    return picked.select("run_id", F.col("x.n").alias("start_n"), F.col("x.end_n").alias("end_n"), F.col("x.count").alias("count"))


def error_rate_spikes(records: DataFrame) -> DataFrame:
    e = records.filter(F.upper("level").isin("ERROR", "CRIT", "CRITICAL")).select("run_id", "n", F.unix_micros("ts").alias("us"))
    d = error_bursts(e)
    text = F.format_string("%d ERROR/CRIT events within 60s", "count")
    lines = F.format_string("lines %d-%d", "start_n", "end_n")
    return found(d, 3, F.lit("medium"), F.lit("error_rate_spike"), text, lines, F.lit(None).cast("string"), F.col("start_n"))


def break_ins(records: DataFrame) -> DataFrame:
    text = F.coalesce("original_msg", "msg", F.lit("")) if "original_msg" in records.columns else F.coalesce("msg", F.lit(""))
    ip = part(P.BRACKETED_IP, 1)
    hits = records.filter(text.rlike(P.BREAK_IN) | F.col("raw").rlike(P.BREAK_IN)).withColumn("_ip", ip).filter("_ip is not null")
    per = hits.groupBy("run_id", "_ip").agg(F.count("*").alias("_n"), F.min_by("raw", "n").alias("_first"), F.min("n").alias("_seq"))
    text = F.format_string("%dx reverse-DNS mismatch flagged as POSSIBLE BREAK-IN from %s", "_n", "_ip")
    return found(per, 4, F.lit("medium"), F.lit("possible_break_in"), text, F.col("_first"), F.col("_ip"), F.col("_seq"), F.col("_n"))


def windows_events(records: DataFrame) -> DataFrame:
    """Event-id rules; needs a ``fields`` map."""
    from loomwatch.operators.canonical import field

    d = records.withColumn("_e", F.regexp_extract(field(P.EVENT_ID_FIELDS), r"\d+", 0)).filter(F.col("_e").isin(list(P.WINDOWS_EVENTS)))
    sev = lookup({k: v[0] for k, v in P.WINDOWS_EVENTS.items()}, F.col("_e"))
    kind = lookup({k: v[1] for k, v in P.WINDOWS_EVENTS.items()}, F.col("_e"))
    host = F.coalesce("host", F.lit("unknown"))
    return found(d, 5, sev, kind, F.concat(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" on "), host), F.col("raw"), host, F.col("n"))


def union_pattern(rules: list[str]) -> str:
    """One pattern that matches whenever any of the rules does: the cheap gate before the ordered sweep."""
    return "(?is)" + "|".join(f"(?:{r})" for r in rules)


def opening_pattern(rules: list[str]) -> str | None:
    """One pattern that matches wherever one of the rules begins, if each begins with a word of a list: words are tried by their first letter, and only
    where a word begins. Without a match no rule has one."""
    words: dict[str, set[str]] = {}
    for r in rules:
        head = re.match(r"\\b\(([^()]*)\)", r)
        for w in head.group(1).split("|") if head else [""]:
            plain = re.match("[a-z]*", w).group()
            if not plain:
                return None
            words.setdefault(plain[0], set()).add(plain[1:])
    return "(?i)(?<![a-z0-9_])(?:" + "|".join(f"{a}(?:{'|'.join(sorted(rest))})" for a, rest in sorted(words.items())) + ")(?![a-z0-9_])"


def once(value: Column) -> Column:
    """The value, worked out once a row: filter and projection of a dear expression do not each repeat it."""
    return F.explode(F.array(value))


def first_threat(text: Column) -> Column:
    """(severity, type) of the first threat pattern that matches, behind one union gate; null without a match."""
    out: Column | None = None
    for sev, kind, rx in P.THREATS:
        value = F.struct(F.lit(sev).alias("severity"), F.lit(kind).alias("type"))
        hit = text.rlike("(?i)" + rx)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(text.rlike(union_pattern([r for *_, r in P.THREATS]).replace("(?is)", "(?i)")), out)


def indicators(text: Column, pattern: str) -> Column:
    """Sorted distinct matches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def threats(records: DataFrame) -> DataFrame:
    d = records.withColumn("_t", once(first_threat(F.col("raw")))).filter("_t is not null")
    host = F.coalesce("host", F.lit("unknown"))
    text = F.concat(F.initcap(F.replace("_t.type", F.lit("_"), F.lit(" "))), F.lit(" detected on "), host)
    return found(d, 6, F.col("_t.severity"), F.col("_t.type"), text, F.col("raw"), host, F.col("n"))


def iocs_observed(records: DataFrame) -> DataFrame:
    raw = F.col("raw")
    some = sum((F.size(indicators(raw, p)) for p in (P.IOC_IP, P.IOC_DOMAIN, P.IOC_HASH)), F.lit(0)) > 0
    d = records.filter(raw.rlike(P.IOC_CONTEXT)).filter(some)
    host = F.coalesce("host", F.lit("unknown"))
    return found(d, 7, F.lit("medium"), F.lit("ioc_observed"), F.concat(F.lit("Potential IOC observed on "), host), raw, host, F.col("n"))


def device_type(text: Column, explicit: Column | None = None) -> Column:
    """The explicit type if it names a known one, else the first pattern in the text, else unknown."""
    out: Column | None = None
    if explicit is not None:
        for kind in P.DEVICES:
            hit = F.lower(explicit).contains(kind)
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
    for kind, rx in P.DEVICES.items():
        hit = text.rlike("(?i)" + rx)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def counted_rules(records: DataFrame, rules: list[tuple[str, str, str]], promote_at: int = P.PROMOTE_AT, samples: int = 8) -> DataFrame:
    """One finding per rule that matched: count, severity raised one level when it recurs, first lines as samples."""
    hits = records.select(
        "run_id", "n", "raw",
        F.explode(F.array_compact(F.array(*(F.when(F.col("raw").rlike("(?i)" + rx), F.struct(F.lit(rid).alias("rule"), F.lit(sev).alias("base"))) for rid, sev, rx in rules)))).alias("h"),
    ).select("run_id", "n", "raw", "h.*")
    k = F.row_number().over(W.partitionBy("run_id", "rule").orderBy("n"))
    per = hits.groupBy("run_id", "rule", "base").agg(F.count("*").alias("hits"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))
    shown = hits.withColumn("_k", k).filter(F.col("_k") <= samples).groupBy("run_id", "rule").agg(F.array_sort(F.collect_list("n")).alias("lines"))
    sev = F.when(F.col("hits") >= promote_at, lookup(P.PROMOTED, F.col("base"))).otherwise(F.col("base"))
    return per.join(shown, ["run_id", "rule"]).withColumn("severity", sev)


def merge_same(anomalies: DataFrame) -> DataFrame:
    """One anomaly per (run, type, summary): occurrences added up, the first in pass and file order stays."""
    order = F.struct("pass_no", "seq")
    rest = [c for c in ANOMALY if c not in ("run_id", "type", "summary", "occurrences")]
    return (
        anomalies.groupBy("run_id", "type", "summary")
        .agg(F.sum(F.coalesce("occurrences", F.lit(1))).alias("occurrences"), F.min_by(F.struct(*rest), order).alias("_f"))
        .select("run_id", "type", "summary", "occurrences", "_f.*")
        .select(*ANOMALY)
    )


def detect(records: DataFrame, anchors_removed: DataFrame | None = None) -> DataFrame:
    """All rules: core rules on deduplicated records, the others on all; merged."""
    core = anchors_removed if anchors_removed is not None else records
    parts = [f(core) for f in (auth_bruteforce, suspicious_outbound, critical_events, disk_pressure, error_rate_spikes)]
    parts += [f(records) for f in (break_ins, threats, iocs_observed)]
    if "fields" in records.columns:
        parts.append(windows_events(records))
    return merge_same(reduce(DataFrame.unionByName, parts))


def by_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(lookup(P.SEVERITY_RANK, F.upper("severity"), F.lit(9)), "pass_no", "seq")
