"""Threat intelligence: observed indicators, matching, indicator feeds, technique links, vulnerability reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.containment import contained
from loomwatch.operators.incidents import severity_rank


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value"))


def observed(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, ioc_type, value): distinct addresses, hashes and domains in a text; an MD5 inside a SHA-256 is none, nor is
    an address a domain."""
    t = F.col(text)
    every = lambda rx: F.regexp_extract_all(t, F.lit(rx), F.lit(0))
    kinds = {
        "ipv4": every(P.IOC_IP), "sha256": F.transform(every(P.SHA256), F.lower), "md5": F.transform(every(P.MD5), F.lower),
        "domain": F.transform(F.filter(every(P.OBSERVED_DOMAIN), lambda d: ~d.rlike(rf"^(?:{P.IOC_IP})$")), F.lower),
    }
    pairs = F.concat(*(F.transform(c, _typed(k)) for k, c in kinds.items()))
    return rows.select(*keys, F.explode(F.array_distinct(pairs)).alias("_p")).select(*keys, "_p.*")


def match(seen: DataFrame, feed: DataFrame) -> DataFrame:
    """Observed indicators that are in the feed, by type and value in lower case. Spark broadcasts the feed only if it is small."""
    f = feed.select("ioc_type", F.lower("value").alias("value"), *(c for c in feed.columns if c not in ("ioc_type", "value")))
    return seen.withColumn("value", F.lower("value")).join(f, ["ioc_type", "value"])


def best_per_value(findings: DataFrame, value: Column, least: str = "INFO") -> DataFrame:
    """One row per flagged value: the worst severity, the first finding among equals."""
    d = findings.withColumn("value", value).filter(F.col("value").isNotNull() & (severity_rank(F.col("severity")) <= P.SEVERITY_RANK[least]))
    k = F.row_number().over(W.partitionBy("value").orderBy(severity_rank(F.col("severity")), "seq"))
    return d.withColumn("_k", k).filter("_k = 1").drop("_k")


STIX_PATTERNS = {
    "ipv4": r"ipv4-addr:value\s*=\s*'([^']+)'", "domain": r"domain-name:value\s*=\s*'([^']+)'", "url": r"url:value\s*=\s*'([^']+)'",
    "sha256": r"file:hashes\.'?SHA-256'?\s*=\s*'([^']+)'", "md5": r"file:hashes\.'?MD5'?\s*=\s*'([^']+)'", "email": r"email-addr:value\s*=\s*'([^']+)'",
}

STIX_SCHEMA = (
    "objects array<struct<type:string,id:string,name:string,pattern:string,indicator_types:array<string>,valid_from:string,"
    "relationship_type:string,source_ref:string,target_ref:string,revoked:boolean,x_mitre_deprecated:boolean,description:string,"
    "external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
)


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STIX_SCHEMA).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")


def stix_iocs(objects: DataFrame) -> DataFrame:
    """(indicator, name, ioc_type, value) of every indicator's pattern."""
    each = F.concat(
        *(F.transform(F.regexp_extract_all("pattern", F.lit(rx), F.lit(1)), _typed(k)) for k, rx in STIX_PATTERNS.items())
    )
    d = objects.filter((F.col("type") == "indicator") & F.col("pattern").isNotNull())
    return d.select(F.col("id").alias("indicator"), "name", "indicator_types", F.explode(each).alias("x")).select("indicator", "name", "indicator_types", "x.*")


def stix_links(objects: DataFrame) -> DataFrame:
    """(indicator, techniques) from ``indicates`` relationships to attack patterns."""
    d = objects.filter((F.col("type") == "relationship") & (F.col("relationship_type") == "indicates") & F.col("target_ref").startswith("attack-pattern"))
    return d.groupBy(F.col("source_ref").alias("indicator")).agg(F.array_sort(F.collect_set("target_ref")).alias("techniques"))


def techniques(objects: DataFrame) -> DataFrame:
    """(stix_id, technique_id, name, phases, description) of live techniques."""
    live = ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    ref = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")[0]["external_id"]
    phases = F.transform("kill_chain_phases", lambda p: F.initcap(F.replace(p["phase_name"], F.lit("-"), F.lit(" "))))
    d = objects.filter((F.col("type") == "attack-pattern") & live)
    return d.select(F.col("id").alias("stix_id"), ref.alias("technique_id"), "name", phases.alias("phases"), F.substring("description", 1, 400).alias("description"))


def feed_ceiling(matches: DataFrame) -> DataFrame:
    """A feed may lower a severity, never raise it: the ceiling follows from a malicious label and a technique."""
    bad = F.arrays_overlap(F.coalesce("indicator_types", F.array().cast("array<string>")), F.array(F.lit("malicious-activity"), F.lit("compromised")))
    known = F.size(F.coalesce("techniques", F.array().cast("array<string>"))) > 0
    ceiling = F.when(bad & known, "CRITICAL").when(bad, "HIGH").when(known, "MEDIUM").otherwise("LOW")
    worse = severity_rank(F.col("severity")) < severity_rank(ceiling)
    return matches.withColumn("ceiling", ceiling).withColumn("severity", F.when(worse, ceiling).otherwise(F.upper("severity")))


def vulnerabilities(scripts: DataFrame, text: str = "output") -> DataFrame:
    """(keys, cve, cvss): CVE ids with a score behind them, else bare ones; one row per id, the scored one first."""
    scored = F.regexp_extract_all(text, F.lit(r"(CVE-\d{4}-\d{4,7})\s+(\d{1,2}\.\d)"), F.lit(1))
    scores = F.regexp_extract_all(text, F.lit(r"(CVE-\d{4}-\d{4,7})\s+(\d{1,2}\.\d)"), F.lit(2))
    bare = F.regexp_extract_all(text, F.lit(r"CVE-\d{4}-\d{4,7}"), F.lit(0))
    rows = F.concat(
        F.zip_with(scored, scores, lambda c, s: F.struct(c.alias("cve"), s.cast("double").alias("cvss"))),
        F.transform(bare, lambda c: F.struct(c.alias("cve"), F.lit(None).cast("double").alias("cvss"))),
    )
    keys = [c for c in scripts.columns if c != text]
    d = scripts.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    return d.groupBy(*keys, "cve").agg(F.max("cvss").alias("cvss")).withColumn("band", cvss_band(F.col("cvss")))


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("INFO")


def address_class(ip: Column) -> Column:
    """private, loopback, link-local or public of a dotted address; null if it is none."""
    o = F.split(ip, r"\.")
    a, b = F.try_element_at(o, F.lit(1)).cast("int"), F.try_element_at(o, F.lit(2)).cast("int")
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    kind = F.when(a == 127, "loopback").when((a == 169) & (b == 254), "link-local").when(private, "private").otherwise("public")
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), kind)


def provider_verdict(responses: DataFrame) -> DataFrame:
    """Score and verdict from saved provider answers: pulses count ten each up to a hundred; a confidence is its own score."""
    pulses, trust = F.col("pulses"), F.col("confidence")
    score = F.when(trust.isNotNull(), trust.cast("double")).otherwise(F.least(F.lit(100.0), F.coalesce(pulses, F.lit(0)) * 10.0))
    bad = F.when(trust.isNotNull(), trust >= 50).otherwise(pulses >= 5)
    return responses.withColumn("score", score).withColumn("verdict", F.when(bad, "malicious").when(score > 0, "suspicious").otherwise("clean"))


def nse_verdict(text: Column) -> Column:
    """(vulnerable, severity) of a scan script's output: explicit negatives first, then positives, then severity words."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    some = lambda words: F.greatest(*(low.contains(w) for w in words)) if len(words) > 1 else low.contains(words[0])
    hit = low.rlike("(?s)" + "|".join(f"(?:{p})" for p in P.NSE_POSITIVE)) | some(P.NSE_WORDS)
    sev = None
    for name, words in P.NSE_SEVERITY:
        sev = F.when(some(words), name) if sev is None else sev.when(some(words), name)
    bad = hit & ~some(P.NSE_NEGATIVE)
    return F.struct(bad.alias("vulnerable"), F.when(bad, sev.otherwise("high")).otherwise("info").alias("severity"))


def inside_patterns(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """(value, indicator): values that an indicator's pattern contains anywhere, found in one pass over the patterns."""
    d = contained(indicators.select(F.col("id").alias("indicator"), "pattern"), values, "indicator", "pattern", "value")
    return d.select("value", "indicator")
