"""Availability rules: coordination-service counts, servicing logs grouped by signature, cross-platform infrastructure alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.rules import device_type, found, opening_pattern, union_pattern
from loomwatch.sources.envelopes import lookup


def zookeeper(records: DataFrame, samples: int = 8) -> DataFrame:
    """Per run and rule: hits, severity by count, first and last line, first lines as samples."""
    each = [F.when(F.col("raw").rlike("(?i)" + rx), rid) for rid, rx, _ in P.ZOOKEEPER_RULES]
    hits = records.select("run_id", "n", F.explode(F.array_compact(F.array(*each))).alias("rule"))
    sev: Column | None = None
    for rid, _, steps in P.ZOOKEEPER_RULES:
        for least, name in steps:
            hit = (F.col("rule") == rid) & (F.col("hits") >= least)
            sev = F.when(hit, name) if sev is None else sev.when(hit, name)
    per = hits.groupBy("run_id", "rule").agg(F.count("*").alias("hits"), F.min("n").alias("first_n"), F.max("n").alias("last_n")).withColumn("severity", sev)
    k = F.row_number().over(W.partitionBy("run_id", "rule").orderBy("n"))
    shown = hits.withColumn("_k", k).filter(F.col("_k") <= samples).groupBy("run_id", "rule").agg(F.array_sort(F.collect_list("n")).alias("lines"))
    return per.join(shown, ["run_id", "rule"])


def quorum_instability(counted: DataFrame) -> DataFrame:
    """Runs in which broken connections meet worker exits or interruptions: the combination says more than each."""
    n = lambda rule: F.coalesce(F.sum(F.when(F.col("rule") == rule, F.col("hits"))), F.lit(0))
    d = counted.groupBy("run_id").agg(
        n("zookeeper_connection_broken").alias("broken"),
        (n("zookeeper_sendworker_exit") + n("zookeeper_sendworker_interrupt") + n("zookeeper_sendworker_interrupted")).alias("workers"),
    )
    sev = F.when((F.col("broken") >= 20) & (F.col("workers") >= 20), "CRITICAL").when((F.col("broken") >= 5) & (F.col("workers") >= 5), "HIGH").otherwise("MEDIUM")
    return d.filter("broken > 0 and workers > 0").withColumn("severity", sev).withColumn("occurrences", F.col("broken") + F.col("workers"))


def signature(text: Column) -> Column:
    """A servicing message without codes, paths and extra white space, at most 96 characters."""
    head = F.regexp_replace(text, P.CBS_HRESULT, "")
    head = F.regexp_replace(head, r"[A-Za-z]:\\[^\s,\]]+", "<path>")
    head = F.regexp_replace(F.regexp_replace(head, r"\s+", " "), r"^[ :\-\[\]]+|[ :\-\[\]]+$", "")
    return F.coalesce(F.nullif(F.substring(head, 1, 96), F.lit("")), F.lit("servicing message"))


def servicing(records: DataFrame, steps: int = 50) -> DataFrame:
    """Servicing failures grouped by (kind, channel, signature); severity from the worst level, the code's family and the count.

    In: (run_id, n, level, channel, msg). The source's level is not changed."""
    code, name = F.nullif(F.regexp_extract("msg", P.CBS_HRESULT, 1), F.lit("")), F.nullif(F.regexp_extract("msg", P.CBS_HRESULT, 2), F.lit(""))
    fail = code.isNotNull() | F.col("msg").rlike(P.CBS_FAIL)
    warn = F.col("msg").rlike(r"(?i)\bwarning\b") | F.upper("level").isin("WARN", "WARNING")
    alert = F.upper("level").isin("WARN", "WARNING", "ERROR", "ERR", "CRIT", "CRITICAL")
    rank = lookup({"CRIT": 4, "CRITICAL": 4, "ERROR": 3, "ERR": 3, "WARN": 2, "WARNING": 2}, F.upper("level"), F.lit(0))
    kind = F.when(code.isNotNull(), "hresult").when(warn & ~fail, "warning").otherwise("failure")
    d = records.filter(fail | warn | alert).withColumn("kind", kind)
    d = d.withColumn("signature", F.when(code.isNotNull(), F.upper(F.coalesce(name, code))).otherwise(signature(F.col("msg")))).withColumn("_rank", rank)
    keys = ["run_id", "kind", "channel", "signature"]
    per = d.groupBy(*keys).agg(F.count("*").alias("hits"), F.max("_rank").alias("_worst"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))
    k = F.row_number().over(W.partitionBy(*keys).orderBy("n"))
    shown = d.withColumn("_k", k).filter(F.col("_k") <= steps).groupBy(*keys).agg(F.array_sort(F.collect_list("n")).alias("lines"))
    store = F.col("signature").rlike(P.CBS_STORE) & (F.col("hits") >= P.CBS_MANY)
    sev = (
        F.when(F.col("_worst") >= 4, "critical").when(F.col("_worst") >= 3, "high")
        .when(F.col("kind") == "hresult", F.when(store, "high").otherwise("medium"))
        .when(F.col("kind") == "warning", F.when(F.col("_worst") >= 2, "medium").otherwise("low")).otherwise("medium")
    )
    return per.join(shown, keys).withColumn("severity", sev).drop("_worst")


def text_severity(text: Column) -> Column:
    """The first family with a match, behind one union pattern each; texts without a word with which a rule begins are not tried."""
    out = None
    for sev, rules in (("critical", P.INFRA_CRITICAL), ("high", P.INFRA_HIGH), ("medium", P.INFRA_MEDIUM), ("low", P.INFRA_LOW)):
        union, opening = union_pattern(rules).replace("(?is)", ""), opening_pattern(rules)
        hit = text.rlike(f"(?i){union}" if opening is None else f"(?i)(?={opening[4:]})(?:{union})")
        out = F.when(hit, sev) if out is None else out.when(hit, sev)
    opening = opening_pattern(P.INFRA_CRITICAL + P.INFRA_HIGH + P.INFRA_MEDIUM + P.INFRA_LOW)
    return out if opening is None else F.when(text.rlike(opening), out)


def infrastructure(records: DataFrame) -> DataFrame:
    """Alerts of many devices: a structured severity wins over the text. Records that other rules own are left out, and low ones
    need one of the words that make them worth a look."""
    text = F.concat_ws(" ", "raw", "msg")
    sev = F.coalesce(lookup(P.STRUCTURED_SEVERITY, F.upper(F.trim("level"))), text_severity(text))
    d = records.withColumn("_sev", sev).filter("_sev is not null")
    owned = text.rlike(P.AUTH_TEXT) | F.col("msg").contains("auth failed for user '") | F.col("msg").contains("auth success for user '")
    if "auth_source" in records.columns:
        owned = owned | F.col("auth_source").isNotNull()
    if "format" in records.columns:
        owned = owned | F.coalesce(F.col("format").isin("bgl", "windows_cbs"), F.lit(False))
    words = F.lit(False)
    for w in P.INFRA_LOW_WORDS:
        words = words | F.lower(text).contains(w)
    d = d.filter(~owned & ((F.col("_sev") != "low") | words)).withColumn("_dev", device_type(text))
    host = F.coalesce("host", F.lit("unknown"))
    title = F.concat(F.initcap(F.replace("_dev", F.lit("_"), F.lit(" "))), F.lit(" "), "_sev", F.lit(" alert on "), host)
    return found(d, 8, F.col("_sev"), F.concat(F.lit("infra_"), "_dev", F.lit("_"), "_sev"), title, F.col("raw"), host, F.col("n"))
