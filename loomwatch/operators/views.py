"""Views over the store: users, key figures, sources, lists of incidents, entity values, chips, evidence timelines, search, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators.incidents import severity_rank
from loomwatch.operators.ranges import range_join
from loomwatch.operators.score import ratio
from loomwatch.sources.envelopes import _time_value, lookup


def user_names(text: Column) -> Column:
    """Every match of every name pattern, in pattern order; a name that two patterns find is there twice."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(rx), F.lit(1)) for rx in P.USER_NAMES))), lambda n: n != "")


def user_rollup(events: DataFrame, findings: DataFrame) -> DataFrame:
    """(name, events, findings, risk, worst): an event counts once for each match, a finding once for each distinct name. In: events
    (msg), findings (title, severity)."""
    e = events.select(F.explode(user_names(F.col("msg"))).alias("name")).groupBy("name").agg(F.count("*").alias("events"))
    sev = F.upper(F.coalesce("severity", F.lit("INFO")))
    f = findings.select(F.explode(F.array_distinct(user_names(F.col("title")))).alias("name"), sev.alias("sev"))
    f = f.groupBy("name").agg(
        F.count("*").alias("findings"), F.sum(lookup(P.SEVERITY_WEIGHT, F.col("sev"), F.lit(1))).alias("risk"), F.min_by("sev", severity_rank(F.col("sev"))).alias("worst")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(f, "name", "full_outer").select("name", zero("events"), zero("findings"), zero("risk"), "worst")


def by_risk(assets: DataFrame, name: str = "name") -> DataFrame:
    """Assets or users, the riskiest first."""
    return assets.orderBy(F.desc("risk"), F.desc("findings"), F.desc("events"), name)


def store_figures(events: DataFrame, assets: DataFrame, vulnerabilities: DataFrame, iocs: DataFrame) -> DataFrame:
    """One row of counts; severities are those that the source reported."""
    sev = F.upper("severity")
    one = events.agg(F.count("*").alias("events"), F.count_if(sev == "CRITICAL").alias("critical"), F.count_if(sev == "HIGH").alias("high"))
    rest = [
        assets.agg(F.count("*").alias("assets")), vulnerabilities.agg(F.count_if(F.upper("status") == "OPEN").alias("open_vulnerabilities")),
        iocs.agg(F.count_if(F.lower("verdict").isin("malicious", "suspicious")).alias("ioc_hits")),
    ]
    for r in rest:
        one = one.crossJoin(r)  # one row each
    return one


def source_status(events: DataFrame, kinds: list[str]) -> DataFrame:
    """(source_type, n) of every known kind, zero included, and of all events (null)."""
    known = events.sparkSession.createDataFrame([(k,) for k in kinds], "source_type string")
    n = events.groupBy("source_type").agg(F.count("*").alias("n"))
    total = events.agg(F.lit(None).cast("string").alias("source_type"), F.count("*").alias("n"))
    return known.join(n, "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).alias("n")).unionByName(total)


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows as a store takes them: missing columns and nulls become the defaults."""
    value = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)
    return rows.select(*(c for c in rows.columns if c not in defaults), *(value(c, v).alias(c) for c, v in defaults.items()))


ASSET = {"criticality": "standard", "owner": ""}
VULNERABILITY = {"severity": "INFO", "status": "open", "cvss": 0.0}
IOC = {"verdict": "unknown", "score": 0.0}


def newest(incidents: DataFrame, state: str | None = None) -> DataFrame:
    """Incidents, the newest first, those without a time last; of one state if given."""
    d = incidents if state is None else incidents.filter(F.col("state") == state)
    return d.orderBy(F.col("last_us").desc_nulls_last(), "incident_id")


def dispositioned(incidents: DataFrame) -> DataFrame:
    return incidents.filter("disposition is not null").orderBy(F.col("disposed_at").desc_nulls_last(), "incident_id")


def top_per(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each key, by count, then value."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))).filter(F.col("rank") <= k)


def entity_values(members: DataFrame) -> DataFrame:
    """(incident, values): what an incident's findings carried: the entity, address chips, derived hosts, names in titles. In:
    incident, entity, chips (array<string>), host, host_derived, title."""
    none = F.array().cast("array<string>")
    some = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "—"), none).otherwise(F.array(c))
    chips = F.filter(F.transform(F.coalesce("chips", none), lambda c: F.trim(c)), lambda c: c.rlike(rf"^(?:{P.IOC_IP})$"))
    host = F.when(F.col("host_derived"), some(F.col("host"))).otherwise(none)
    each = F.concat(some(F.col("entity").cast("string")), chips, host, F.transform(user_names(F.col("title")), lambda c: F.trim(c)))
    return members.select("incident", F.explode(each).alias("v")).groupBy("incident").agg(F.array_sort(F.collect_set("v")).alias("values"))


def report_chips(findings: DataFrame, report: DataFrame) -> DataFrame:
    """(finding, chips): technique chips of the report rows that name one of a finding's addresses, else the rows' own names. In:
    findings (finding, ips), report (value, name, techniques array<struct<id,name>>)."""
    ips = findings.select("finding", F.explode(F.array_distinct("ips")).alias("value"))
    named = F.transform("techniques", lambda t: F.concat(t["id"], F.lit(" · "), t["name"]))
    text = F.when(F.size("techniques") > 0, named).otherwise(F.array(F.coalesce("name", F.lit("threat-intel match"))))
    return ips.join(report, "value").select("finding", F.explode(text).alias("c")).groupBy("finding").agg(F.array_sort(F.collect_list("c")).alias("chips"))


def evidence_records(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings with the first record of their run that equals their evidence line; null where none does. Lines meet by hash and are compared."""
    cited = findings.select("run_id", "evidence").filter("evidence is not null").distinct().withColumn("_h", F.xxhash64("evidence"))
    near = records.select("run_id", "n", "ts", "raw", F.xxhash64("raw").alias("_h")).join(cited, ["run_id", "_h"]).filter(F.col("raw") == F.col("evidence"))
    first = near.groupBy("run_id", "_h", "evidence").agg(F.min(F.struct("n", "ts")).alias("_r")).drop("_h")
    return findings.join(first, ["run_id", "evidence"], "left").select(*findings.columns, F.col("_r.n").alias("n"), F.col("_r.ts").alias("ts"))


def span_steps(ranges: DataFrame, records: DataFrame) -> DataFrame:
    """First and last record of each finding's range of lines. In: ranges (run_id, finding, lo, hi)."""
    j = range_join(records.select("run_id", "n", "ts"), ranges.select("run_id", "finding", "lo", "hi"), ["run_id"], "n", "lo", "hi")
    d = j.groupBy("run_id", "finding").agg(F.min(F.struct("n", "ts")).alias("a"), F.max(F.struct("n", "ts")).alias("b"), F.count("*").alias("records"))
    return d.select("run_id", "finding", F.col("a.n").alias("first_n"), F.col("a.ts").alias("first_ts"), F.col("b.n").alias("last_n"), F.col("b.ts").alias("last_ts"), "records")


def timelines(findings: DataFrame, records: DataFrame, burst_s: int = 60) -> DataFrame:
    """(run_id, finding, step, n, ts, label): what ties a finding to records, in steps from 1.

    A burst opens and closes with the first and last line of its range; a break-in source has its first and last mismatch record (by time, those without one
    last, then by line); any other finding has the first record of the run that is its evidence. In: findings (run_id, finding, type, evidence, lo, hi, ip, count,
    summary), records (run_id, n, ts, raw)."""
    kind = F.col("type")
    step = lambda k, n, ts, label: F.struct(F.lit(k).alias("step"), n.alias("n"), ts.alias("ts"), label.alias("label"))
    at = records.select("run_id", "n", "ts")
    burst = findings.filter((kind == "error_rate_spike") & F.col("lo").isNotNull())
    ends = burst.select("run_id", "finding", "count", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("n"), "lo").join(at, ["run_id", "n"])
    closes = F.concat(F.lit("Event "), F.coalesce(F.col("count").cast("string"), F.lit("?")), F.lit(f" closes the {burst_s}s window"))
    opened = F.col("n") == F.col("lo")
    ends = ends.select("run_id", "finding", F.when(opened, 1).otherwise(2).alias("step"), "n", "ts", F.when(opened, "Burst window opens").otherwise(closes).alias("label"))
    raw = records.filter(F.col("raw").rlike(P.BREAK_IN)).select("run_id", "n", "ts", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(P.IOC_IP), F.lit(0)))).alias("ip"))
    order = F.struct(F.col("ts").isNull().alias("late"), "ts", "n")
    per = raw.groupBy("run_id", "ip").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("hits"))
    per = findings.filter(kind == "possible_break_in").select("run_id", "finding", "ip").join(per, ["run_id", "ip"])
    first = step(1, F.col("a.n"), F.col("a.ts"), F.concat(F.lit("First reverse-DNS mismatch flagged from "), F.col("ip")))
    last = step(2, F.col("b.n"), F.col("b.ts"), F.format_string("Mismatch %d from the same source", "hits"))
    broke = per.select("run_id", "finding", F.explode(F.when(F.col("hits") > 1, F.array(first, last)).otherwise(F.array(first))).alias("s")).select("run_id", "finding", "s.*")
    rest = findings.filter(~kind.isin("error_rate_spike", "possible_break_in", "auth_bruteforce", "auth_bruteforce_success"))
    one = evidence_records(rest.select("run_id", "finding", "evidence", F.substring("summary", 1, 150).alias("label")), records).filter("n is not null")
    return ends.unionByName(broke).unionByName(one.select("run_id", "finding", F.lit(1).alias("step"), "n", "ts", "label"))


def member_facts(incidents: DataFrame, findings: DataFrame) -> DataFrame:
    """(incident, members, loaded, note, lines): an incident's findings joined back, their lines in one order."""
    each = incidents.select("incident", F.explode_outer("finding_ids").alias("finding"))
    j = each.join(findings.select("finding", "lines", F.lit(True).alias("_l")), "finding", "left")
    d = j.groupBy("incident").agg(
        F.count("finding").alias("members"), F.count_if(F.col("_l")).alias("loaded"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("lines", F.array().cast("array<bigint>")))))).alias("lines")
    )
    return d.withColumn("note", F.when(F.col("loaded") < F.col("members"), F.format_string("%d of %d findings loaded", "loaded", "members")))


def not_cited(events: DataFrame, cites: DataFrame, limit: int) -> DataFrame:
    """The first events of each run that no finding cites."""
    d = events.join(cites.select("run_id", F.col("line").alias("n")), ["run_id", "n"], "left_anti")
    return d.withColumn("_k", F.row_number().over(W.partitionBy("run_id").orderBy("n"))).filter(F.col("_k") <= limit).drop("_k")


def search(events: DataFrame, words: list[str], limit: int = 12) -> DataFrame:
    """The first events that hold any of the words, whatever the case; at most eight words, the longest first."""
    some = sorted({w.lower() for w in words if w}, key=lambda w: (-len(w), w))[:8]
    text = F.lower(F.concat_ws(" ", F.coalesce("raw", F.lit("")), F.coalesce("msg", F.lit(""))))
    hit = F.lit(False)
    for w in some:
        hit = hit | F.contains(text, F.lit(w))
    return events.filter(hit).orderBy("n").limit(limit)


def training_labels(findings: DataFrame, malicious: DataFrame, noise: str = "noise") -> DataFrame:
    """Findings with a label: the scenario's class if they cite a malicious line, else noise. In: findings (id, scenario, line), malicious
    (scenario, line, class)."""
    hit = findings.join(malicious, ["scenario", "line"], "left").groupBy("id", "scenario").agg(F.max("class").alias("_c"))
    return hit.select("id", "scenario", F.coalesce("_c", F.lit(noise)).alias("label"))


def disposition_labels(incidents: DataFrame, labels: list[str]) -> DataFrame:
    """Closed incidents whose disposition is a known label; others are skipped."""
    return incidents.filter((F.col("state") == "resolved") & F.col("disposition").isin(labels)).select("incident_id", F.col("disposition").alias("label"))


def run_scorecard(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Misses, false positives, precision and recall of each system, by ``keys`` and in total (keys null). In: keys, system, tp, fp, fn."""
    d = cards.cube(*keys, "system").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.grouping("system").alias("_g"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.filter("_g = 0").drop("_g").withColumn("precision", p).withColumn("recall", r)


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one case has and the other has not, duplicates counted; equal cases give none."""
    left, right = a.exceptAll(b).withColumn("side", F.lit("first")), b.exceptAll(a).withColumn("side", F.lit("second"))
    return left.unionByName(right)


def scalar(text: Column) -> Column:
    """A field's text as a value: true, false and null words lose their case, none becomes null, other text is trimmed."""
    t = F.trim(text)
    low = F.lower(t)
    return F.when(low.isin("null", "none", ""), F.lit(None)).when(low.isin("true", "false"), low).otherwise(t)


def labels_of(ts: Column) -> Column:
    """(clock, iso, day) labels of a time; a dash where there is none."""
    f = lambda p: F.coalesce(F.date_format(ts, p), F.lit("—"))
    return F.struct(f("HH:mm:ss").alias("clock"), f("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), f("yyyy-MM-dd").alias("day"))


def universal(lines: DataFrame) -> DataFrame:
    """Records from fields of any naming: message, time, level and host by their aliases, level words brought to one
    vocabulary (unknown ones pass), the fields as JSON where there is no message. In: run_id, n, raw, fields (map)."""
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))))
    d = lines.withColumn("_f", low)
    pick = lambda names: F.coalesce(*(scalar(F.try_element_at("_f", F.lit(n))) for n in names))
    given = pick(P.JSON_LEVEL)
    return d.select(
        "run_id", "n", _time_value(pick(P.JSON_TS)).alias("ts"), F.coalesce(lookup(P.JSON_LEVELS, F.lower(given)), F.upper(given)).alias("level"),
        pick(P.JSON_HOST).alias("host"), F.coalesce(pick(P.JSON_MSG), F.to_json("fields")).alias("msg"), "raw",
    )


def bridge(records: DataFrame) -> DataFrame:
    """Fills what a parser left out, and nothing else: number from line, time from timestamp text, level from severity, host and
    message as empty text."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    text = lambda c: F.nullif(has(c), F.lit(""))
    new = {
        "n": F.coalesce(has("n").cast("long"), has("line").cast("long")), "ts": F.coalesce(has("ts").cast("timestamp"), _time_value(has("timestamp").cast("string"))),
        "level": F.coalesce(text("level"), has("severity"), F.lit("")), "host": F.coalesce(text("host"), F.lit("")), "msg": F.coalesce(text("msg"), has("message"), F.lit("")),
    }
    return records.withColumns(new)
