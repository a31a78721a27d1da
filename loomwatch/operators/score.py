"""Scoring of findings against labels, and comparison of two sets of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.operators.containment import contained_rows
from loomwatch.operators.incidents import severity_rank
from loomwatch.operators.ranges import range_join


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    """Null where the denominator is zero: not defined is not zero."""
    return F.round(a / F.nullif(b, F.lit(0)), places)


def f1(p: Column, r: Column) -> Column:
    return F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 4)


def set_score(found: DataFrame, expected: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets of rows."""
    by = by or []
    a = found.select(*(F.col(k).alias(f"_a_{k}") for k in keys)).distinct().withColumn("_f", F.lit(1))
    b = expected.select(*(F.col(k).alias(f"_b_{k}") for k in keys)).distinct().withColumn("_e", F.lit(1))
    cond = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    both = a.join(b, cond, "full_outer").select(*(F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys), "_f", "_e")
    tp, fp, fn = (F.count_if(c) for c in (F.col("_f").isNotNull() & F.col("_e").isNotNull(), F.col("_e").isNull(), F.col("_f").isNull()))
    s = both.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def cited_hits(findings: DataFrame, labelled: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(on, finding, line): labelled lines that a finding accounts for, once each: lines in its range, and lines that its evidence quotes verbatim.

    In: findings (on, finding, lo, hi, evidence), labelled (on, line, raw); ``on`` names the columns of a run. A blank line is quoted by nothing."""
    on = on or []
    r = findings.select(*on, "finding", "lo", "hi").distinct()
    by_range = range_join(labelled.select(*on, "line").distinct(), r, on, "line", "lo", "hi").select(*on, "finding", "line")
    quoted = labelled.select(*(F.col(c).alias(f"_of_{c}") for c in on), "line", F.btrim("raw", F.lit(" \t\r\n")).alias("raw"))
    texts = findings.filter("evidence is not null").select(F.struct(*on, "finding").alias("_f"), "evidence")
    verbatim = contained_rows(texts, quoted, "_f", "evidence", "raw")
    for c in on:
        verbatim = verbatim.filter(F.col(f"_f.{c}") == F.col(f"_of_{c}"))
    return by_range.unionByName(verbatim.select("_f.*", "line")).distinct()


def scorecard(findings: DataFrame, hits: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per rule and in total (rule_id null): findings, true findings, lines hit once each, recall over labelled lines.

    In: findings (rule_id, finding), hits (finding, line), labelled (line)."""
    total = F.broadcast(labelled.select("line").distinct().agg(F.count("*").alias("labelled")))  # one row
    j = findings.select("rule_id", "finding").distinct().join(hits.select("finding", "line"), "finding", "left")
    per = j.rollup("rule_id").agg(
        F.count_distinct("finding").alias("findings"), F.count_distinct(F.when(F.col("line").isNotNull(), F.col("finding"))).alias("true_findings"), F.count_distinct("line").alias("lines_hit"),
    )
    d = per.crossJoin(total)
    return d.withColumn("precision", ratio(F.col("true_findings"), F.col("findings"))).withColumn("recall", ratio(F.col("lines_hit"), F.col("labelled")))


def misses(findings: DataFrame, hits: DataFrame, labelled: DataFrame, by: str, keep: int) -> DataFrame:
    """Where a scorecard loses: (by, kind, n, samples) for labelled lines that no finding hits (``miss``) and findings that hit none (``false positive``), by
    format and in total (by null). ``samples``: the first ``keep`` of each group verbatim; ranks are limited before the shuffle, so a group is never gathered.

    In: findings (by, finding, evidence), hits (finding, line), labelled (by, line, raw)."""
    lines = labelled.select(by, F.lit("miss").alias("kind"), F.col("line").alias("_at"), F.col("raw").alias("text"))
    both = lines.unionByName(findings.select(by, F.lit("false positive").alias("kind"), F.col("finding").alias("_at"), F.col("evidence").alias("text")))
    # hits are worked out once for lines and findings
    at = both.schema["_at"].dataType
    hit = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast(at).alias("_at")) for k, c in (("miss", "line"), ("false positive", "finding"))))
    d = both.join(hits.select(F.explode(hit).alias("_h")).select("_h.*").distinct(), ["kind", "_at"], "left_anti")
    counted = d.groupBy("kind", by).agg(F.count("*").alias("n")).groupingSets([["kind", by], ["kind"]], "kind", by).agg(F.sum("n").alias("n"), F.grouping(by).alias("_all"))
    # the first of all are among the first of each format
    rank = lambda *of: F.row_number().over(W.partitionBy(*of).orderBy("_at", "text"))
    first = d.withColumn("_k", rank("kind", by)).filter(F.col("_k") <= keep)
    both = first.withColumn("_all", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<byte>"))).withColumn(by, F.when(F.col("_all") == 0, F.col(by)))
    some = both.withColumn("_k", rank("_all", "kind", by)).filter(F.col("_k") <= keep).groupBy("_all", "kind", by)
    listed = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]).alias("samples"))
    same = (counted["_all"] == listed["_all"]) & (counted["kind"] == listed["kind"]) & counted[by].eqNullSafe(listed[by])
    return counted.join(listed, same).select(counted[by], counted["kind"], "n", "samples")


def align(rules: DataFrame, model: DataFrame, covered: bool = True) -> DataFrame:
    """What a model alone made of each rule finding: (id, model_id, model_severity, delta).

    A model finding matches on a shared address, a shared line, or the same host where not both cite lines; the most severe one (of equals the first)
    counts. In: rules (id, severity, ips, host, lines), model (id, severity, ips, hosts, lines). Each value keeps its best model finding before
    the join, so that rows follow the findings' values and never their pairs. No match is MISSED, or UNKNOWN where the model gave no usable
    output (``covered`` false)."""
    sev = F.upper(F.coalesce("severity", F.lit("INFO")))
    rank = lambda c: F.least(severity_rank(c), F.lit(4))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    m = model.select(F.struct(rank(sev).alias("rank"), F.col("id").alias("id"), sev.alias("sev")).alias("b"), "ips", "hosts", "lines")
    r = rules.select(F.col("id"), sev.alias("severity"), "ips", "host", "lines")
    best = F.min("b").alias("b")
    parts = []
    for k in ("ips", "lines"):
        of_value = m.select("b", F.explode(F.array_distinct(k)).alias("v")).groupBy("v").agg(best)
        parts.append(r.select("id", F.explode(F.array_distinct(k)).alias("v")).join(of_value, "v").select("id", "b"))
    hosts = m.select("b", none("lines").alias("bare"), F.explode(F.array_distinct("hosts")).alias("host")).groupBy("host").agg(best, F.min(F.when(F.col("bare"), F.col("b"))).alias("bare"))
    parts.append(r.select("id", "host", none("lines").alias("free")).join(hosts, "host").select("id", F.when(F.col("free"), F.col("b")).otherwise(F.col("bare")).alias("b")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(best)
    d = r.select("id", "severity").join(found, "id", "left")
    own, given = rank(F.col("severity")), F.coalesce(F.col("b.rank"), F.lit(5))
    delta = F.when(given > own, "under-rated").when(given < own, "over-rated").otherwise("agree")
    if not covered:
        delta = F.when(F.col("b").isNull(), "unknown").otherwise(delta)
    return d.select("id", F.col("b.id").alias("model_id"), F.coalesce("b.sev", F.lit("MISSED" if covered else "UNKNOWN")).alias("model_severity"), delta.alias("delta"))


def chunks(findings: DataFrame, line: str, keys: list[str], size: int = 25) -> DataFrame:
    """Which chunks of lines hold findings, how many and which lines."""
    d = findings.withColumn("chunk", F.floor((F.col(line) - 1) / size))
    return d.groupBy(*keys, "chunk").agg(F.count("*").alias("findings"), F.min(line).alias("first_line"), F.max(line).alias("last_line"))


def merged_recall(scorecards: DataFrame) -> DataFrame:
    """Recall per rule and in total (rule_id null) over many scorecards, from summed pairs (hit, expected)."""
    d = scorecards.rollup("rule_id").agg(F.sum("hit").alias("hit"), F.sum("expected").alias("expected"))
    return d.withColumn("recall", ratio(F.col("hit"), F.col("expected")))


def dropped_true(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings that cite a labelled line and that a decision (finding, kept) dropped."""
    return findings.join(decisions.filter(~F.col("kept")), "finding").filter("hits > 0")


def inventory(lines: DataFrame, text: str, key: str) -> DataFrame:
    """(key, value): addresses and quoted user names of each log set."""
    from loomwatch.functions import patterns as P

    each = F.concat(F.regexp_extract_all(text, F.lit(P.IOC_IP), F.lit(0)), F.regexp_extract_all(text, F.lit("user '([^']+)'"), F.lit(1)))
    return lines.select(key, F.explode(each).alias("value")).distinct()


def shared_values(inventories: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Values that both sets hold; disjoint sets have none."""
    side = lambda k: inventories.filter(F.col(key) == k).select("value")
    return side(a).intersect(side(b))


def severity_mismatch(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings that agree in rule and entity but not in severity."""
    a, b = found.select("rule", "entity", F.col("severity").alias("found")), expected.select(F.col("rule").alias("_r"), F.col("entity").alias("_e"), F.col("severity").alias("expected"))
    return a.join(b, (F.col("rule") == F.col("_r")) & F.col("entity").eqNullSafe(F.col("_e"))).filter(F.lower("found") != F.lower("expected")).drop("_r", "_e")
