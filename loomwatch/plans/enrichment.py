"""Structured files' rows, intelligence, scoring and ledger queries on the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators import canonical as C, containment, enrich, incidents as I, infra, intel, investigate, ledger, redact, rollups, rules, runbooks, score, triage
from loomwatch.plans.console import _F, _e
from loomwatch.plans.ingest import _SEC, _list, _rx
from loomwatch.session import table
from loomwatch.sources import envelopes as E, lines as L, structured as S

HEADS = ["<Events><Event>", "<html><body>", "<root><a/>", '{"a":1}\n{"b":2}', '{"a": 1}', "EventCode=4624\nx", "a,b,c\n1,2,3", "plain words", "  "]
KINDS = ["evtx_xml", "html", "xml", "jsonl", "json", "windows_text", "csv", "text", "empty"]


def universal_formats(spark, sf_dir):
    """Heads of nine kinds of files, and of web pages."""
    e = table(spark, sf_dir, "events")
    d = e.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("run_id"), F.element_at(F.array(*map(F.lit, HEADS)), (F.pmod("event_id", F.lit(len(HEADS))) + 1).cast("int")).alias("head"))
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("run_id"), F.coalesce("html", F.lit("")).alias("head"))
    p = p.select(F.lit("p").alias("run_id"), "head").filter("trim(head) ilike '<!doctype html%' or trim(head) ilike '<html%'")
    return L.universal_format(d.unionByName(p)).groupBy("format").agg(F.count("*").alias("n"))


def accepted_native(spark, sf_dir):
    """Days of which most lines parse keep their own parser, the others take the universal one."""
    e = _e(spark, sf_dir)
    bad = F.pmod("n", F.lit(10)) < F.when(F.pmod(F.dayofmonth("ts"), F.lit(2)) == 0, 6).otherwise(2)
    raw = F.when(bad, F.concat(F.lit("odd "), "body")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" INFO "), "host", F.lit(" "), "body"))
    lines = e.select("run_id", "n", raw.alias("raw"))
    native, universal = E.canonical(lines), E.generic(lines)
    d = L.accept_native(native, universal, L.coverage(lines, native))
    return d.groupBy("run_id", "format").agg(F.count("*").alias("n"))


def json_lines(spark, sf_dir):
    e = _e(spark, sf_dir)
    raw = F.when(F.pmod("n", F.lit(7)) == 0, "{oops").when(F.pmod("n", F.lit(7)) == 1, "").otherwise(F.to_json(F.struct("event_type", "host")))
    good, bad = S.json_lines(e.select("run_id", "n", raw.alias("raw")))
    a = good.groupBy("run_id").agg(F.count("*").alias("good"), F.count_distinct(F.element_at("fields", "host")).alias("hosts"))
    return a.join(bad.groupBy("run_id").agg(F.count("*").alias("bad")), "run_id", "full_outer")


def auth_csv(spark, sf_dir):
    """Rows of an authentication export through the one vocabulary, failures and successes per source."""
    e = _e(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "Success").otherwise("n/a")
    m = F.create_map(F.lit("timestamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("username"), F.col("host"), F.lit("ip_address"), F.when(F.pmod("n", F.lit(9)) != 0, F.col("ip")), F.lit("status"), status)
    r = C.canonicalise(S.auth_csv(e.select("run_id", "n", F.lit("").alias("raw"), m.alias("fields"))))
    return r.groupBy(F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce("auth_source", F.lit("-")).alias("source")).agg(F.count("*").alias("n"), F.count_distinct("auth_ip").alias("ips"), F.sum(F.unix_seconds("ts")).alias("sum_ts"))


def log360_csv(spark, sf_dir):
    e = _e(spark, sf_dir)
    sev = E.lookup({"error": "Error", "purchase": "Warning", "click": "Information", "view": "Debug", "signup": "Emergency"}, F.col("event_type"))
    when = F.when(F.pmod("n", F.lit(2)) == 0, F.date_format("ts", "MMM dd, yyyy h:mm:ss a")).otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
    m = F.create_map(F.lit("message"), F.when(F.pmod("n", F.lit(11)) != 0, F.col("body")), F.lit("severity"), sev, F.lit("time"), when, F.lit("device"), F.col("host"))
    d = S.log360_csv(e.select("run_id", "n", F.lit("").alias("raw"), m.alias("fields")))
    return d.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.sum(F.unix_seconds("ts")).alias("sum_ts"))


def windows_text(spark, sf_dir):
    """Events as text blocks of five lines, one of them a continuation."""
    e = _e(spark, sf_dir)
    block = F.array(F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"), F.concat(F.lit("ComputerName="), "host"), F.lit("EventCode=4625"), F.concat(F.lit("Message="), "body"), F.lit("  more of it"))
    lines = e.select("run_id", F.col("n").alias("_e"), F.posexplode(block).alias("p", "raw")).select("run_id", (F.col("_e") * 10 + F.col("p") + 1).alias("n"), "raw")
    d = S.windows_text(lines)
    return d.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.sum(F.unix_seconds("ts")).alias("sum_ts"), F.count_if(F.col("msg").endswith("\n  more of it")).alias("whole"))


def rule_predicates(spark, sf_dir):
    """Findings with the predicate of their rule."""
    types = ["auth_bruteforce", "disk_pressure", "threat_x", "infra_y", "odd", "windows_audit_log_cleared"]
    e = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, types)), (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("type"))
    return enrich.with_predicate(e).groupBy("type", "predicate").agg(F.count("*").alias("n"))


STIX = "type string, id string, name string, pattern string, indicator_types array<string>, relationship_type string, source_ref string, target_ref string, revoked boolean, x_mitre_deprecated boolean, description string, external_references array<struct<source_name:string,external_id:string>>, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>"


def _stix(spark, sf_dir):
    """Suppliers as indicators, nations as techniques, a relationship for each supplier."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    none = F.lit(None)
    cols = {c.split()[0]: c.split(" ", 1)[1] for c in STIX.split(", ")}
    make = lambda d, **kw: d.select(*(kw.get(c, none).cast(t).alias(c) for c, t in cols.items()))
    ident = F.concat(F.lit("indicator--"), F.col("s_suppkey").cast("string"))
    i = make(s, type=F.lit("indicator"), id=ident, name=F.col("s_name"), pattern=F.format_string("[ipv4-addr:value = '10.9.%d.%d' OR domain-name:value = 'h%d.net']", F.pmod("s_suppkey", F.lit(5)), F.pmod("s_suppkey", F.lit(7)), "s_suppkey"), indicator_types=F.array(F.lit("malicious-activity")))
    r = make(s, type=F.lit("relationship"), id=ident, relationship_type=F.when(F.pmod("s_suppkey", F.lit(4)) != 0, "indicates").otherwise("uses"), source_ref=ident, target_ref=F.concat(F.lit("attack-pattern--"), F.col("s_nationkey").cast("string")))
    a = make(
        n, type=F.lit("attack-pattern"), id=F.concat(F.lit("attack-pattern--"), F.col("n_nationkey").cast("string")), name=F.col("n_name"), revoked=F.pmod("n_nationkey", F.lit(6)) == 0,
        external_references=F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("external_id"))),
        kill_chain_phases=F.array(F.struct(F.lit("k").alias("kill_chain_name"), F.lit("initial-access").alias("phase_name"))),
    )
    return i.unionByName(r).unionByName(a)


def stix_chain(spark, sf_dir):
    """Addresses of events against indicator patterns, with the live techniques that the indicators point to."""
    o = _stix(spark, sf_dir)
    seen = _e(spark, sf_dir).select(F.concat(F.lit("10.9."), F.pmod("user_id", F.lit(6)).cast("string"), F.lit("."), F.pmod("n", F.lit(9)).cast("string")).alias("value")).distinct()
    m = seen.join(intel.stix_iocs(o).filter("ioc_type = 'ipv4'").select("value", "indicator"), "value")
    d = enrich.technique_chain(m, intel.stix_links(o), intel.techniques(o))
    return d.groupBy("value").agg(F.count("*").alias("indicators"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("chain", lambda c: c["technique_id"]))))), ",").alias("techniques"))


def pattern_members(spark, sf_dir):
    """Observed values that lie anywhere inside an indicator's pattern: h1 is inside 'h12.net' too."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), F.pmod("s_suppkey", F.lit(40)).cast("string")).alias("value"))
    d = intel.inside_patterns(s, _stix(spark, sf_dir).filter("type = 'indicator'"))
    return d.groupBy("value").agg(F.count("*").alias("indicators"))


def contained_terms(spark, sf_dir):
    """First words of benchmark passages, eight letters and more, wherever they stand in documents: more and less than can be sent as one automaton."""
    docs = table(spark, sf_dir, "documents")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)), 1, 3)).alias("word"))
    for sent, name in ((containment.SENT_CHARS, "sent"), (0, "met")):
        d = containment.contained(docs, words, "doc_id", "text", "word", sent).groupBy("doc_id").agg(F.count("*").alias(name))
        out = d if name == "sent" else out.join(d, "doc_id", "full_outer")
    return out


def restated_findings(spark, sf_dir):
    """Model findings (large quantities) that share no part with a rule's finding (flag R) of the order."""
    li = table(spark, sf_dir, "lineitem")
    marks = lambda d: d.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("id"), F.array(F.concat(F.lit("p"), F.pmod("l_partkey", F.lit(5)).cast("string"))).alias("markers"))
    d = enrich.restated(marks(li.filter("l_quantity > 30")), marks(li.filter("l_returnflag = 'R'")))
    return d.agg(F.count("*").alias("n"), F.sum("run_id").alias("sum_run"))


NSE_TEXT = ["State: VULNERABLE (critical)", "target is vulnerable, risk medium", "NOT VULNERABLE", "remote code execution possible", "nothing here", "CVE-2020-1234 low"]


def nse_verdicts(spark, sf_dir):
    t = F.element_at(F.array(*map(F.lit, NSE_TEXT)), (F.pmod("event_id", F.lit(len(NSE_TEXT))) + 1).cast("int"))
    v = intel.nse_verdict(t)
    return table(spark, sf_dir, "events").groupBy(t.alias("text"), v["vulnerable"].alias("vulnerable"), v["severity"].alias("severity")).agg(F.count("*").alias("n"))


def dropped_true(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("finding")).agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    dec = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding"), (F.col("o_orderstatus") != "O").alias("kept"))
    return score.dropped_true(f, dec).select("finding", "hits")


def opinion_agreement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") < "3", "high").otherwise("low").alias("severity"), F.when(F.col("o_orderstatus") == "O", "HIGH").otherwise("LOW").alias("opinion"))
    return triage.agreement(o)


def shared_entities(spark, sf_dir):
    """Addresses and names that two languages' documents share."""
    d = table(spark, sf_dir, "documents").select("lang", F.concat(F.coalesce("text", F.lit("")), F.lit(" user '"), F.pmod("doc_id", F.lit(30)).cast("string"), F.lit("'")).alias("t"))
    return score.shared_values(score.inventory(d, "t", "lang"), "lang", "en", "de")


def run_headers(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("source", F.when(F.col("event_type") == "view", "model").otherwise("rule")).withColumn("host_derived", F.col("user_id") < 3)
    return rollups.run_header(e).select("run_id", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"), F.array_join("hosts", ",").alias("hosts"), "model", "rules")


def runbook_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderpriority").alias("runbook"), F.col("o_orderkey").alias("incident"), (F.col("o_totalprice") > 300_000).alias("eligible"), F.when(F.col("o_totalprice") > 300_000, F.array().cast("array<string>")).when(F.col("o_orderstatus") == "O", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("missing"))
    return runbooks.scan(c).select("runbook", "incident", "eligible", F.array_join("missing", ",").alias("missing"))


def audit_index(spark, sf_dir):
    """Index rows of customers whose chain of orders holds; every fiftieth order breaks one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ledger"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    text = F.sha2(ledger.canonical_json(["seq", "status"]), 256)
    d = o.withColumn("entry_hash", F.when(F.pmod("seq", F.lit(50)) == 3, "x").otherwise(text)).withColumn("prev_hash", F.lag("entry_hash").over(_by_ledger()))
    return ledger.audit_index(d, ledger.verify_chain(d, "ledger", "seq", "prev_hash", "entry_hash", text), "ledger", ["seq", "entry_hash"])


def _by_ledger():
    from pyspark.sql import Window as W

    return W.partitionBy("ledger").orderBy("seq")


def severity_order(spark, sf_dir):
    """A day's anomalies in order of severity, then of rule and line, as rank."""
    e = _e(spark, sf_dir)
    a = rules.found(e.filter("run_id = 'day-2024-01-03'"), 3, F.lower("severity"), F.col("event_type"), F.lit("s"), F.col("body"), F.col("host"), F.col("n"))
    rows = rules.by_severity(a).limit(60)
    return rows.select("severity", "type", "seq")


def case_timeline(spark, sf_dir):
    """Errors and purchases of a day in one order, a line once."""
    e = _e(spark, sf_dir).select("run_id", "n", F.unix_micros("ts").alias("us"), "event_type")
    a = e.filter("event_type = 'error'").select("run_id", "n", "us", F.lit("x").alias("label"))
    b = e.filter("event_type in ('error', 'purchase')").select("run_id", "n", "us", F.lit("x").alias("label"))
    return investigate.timeline(a, b).groupBy("run_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def severity_mismatches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("rule"), F.col("o_orderkey").alias("entity"), F.when(F.col("o_totalprice") > 200_000, "high").otherwise("low").alias("severity"))
    want = o.select("rule", "entity", F.when(F.pmod("entity", F.lit(3)) == 0, "HIGH").otherwise(F.upper("severity")).alias("severity"))
    return score.severity_mismatch(o, want).select("entity", "found", "expected")


def incident_ids(spark, sf_dir):
    """Deterministic ids of a user's day as an incident."""
    e = _e(spark, sf_dir)
    c = e.select("run_id", F.col("user_id").alias("entity"), F.lit(0).alias("cluster"), "severity", F.col("event_type").alias("type"), F.unix_micros("ts").alias("us"), F.col("n").alias("id"))
    return I.incidents(c).select("run_id", "entity", "incident_id")


def remapped_tokens(spark, sf_dir):
    """Tokens of one scope rewritten as another's, whole and the longest first."""
    e = _e(spark, sf_dir).select("n", F.concat(F.lit("[IP-"), F.pmod("n", F.lit(30)).cast("string"), F.lit("] seen")).alias("t"))
    d = redact.remap(e, "t", {"[IP-1]": "[IP-9]", "[IP-9]": "[IP-1]", "[IP-12]": "[IP-120]"})
    return d.groupBy("t").agg(F.count("*").alias("n"))


def infrastructure_events(spark, sf_dir):
    """Infrastructure alerts of records: vendor severity first, then the text families."""
    e = _e(spark, sf_dir)
    msg = E.lookup({"error": "interface ge-0/0/1 down", "click": "power supply failed", "view": "all quiet"}, F.col("event_type"), F.lit("link flapping"))
    r = e.select("run_id", "n", "ts", "host", F.when(F.pmod("n", F.lit(3)) == 0, "CRITICAL").alias("level"), msg.alias("msg"), msg.alias("raw"))
    d = infra.infrastructure(r)
    return d.groupBy("severity").agg(F.sum("occurrences").alias("n"))


QUERIES = {f.__name__: f for f in (
    universal_formats, accepted_native, json_lines, auth_csv, log360_csv, windows_text, rule_predicates, stix_chain, pattern_members, contained_terms, restated_findings, nse_verdicts,
    dropped_true, opinion_agreement, shared_entities, run_headers, runbook_scan, audit_index, severity_order, case_timeline, severity_mismatches, incident_ids, remapped_tokens,
    infrastructure_events,
)}


def _family(rules: list[str]) -> str:
    return _rx("|".join(f"(?:{r})" for r in rules))


def _value(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_PREDICATES = enrich.predicates() | {"threat_x": "a registered threat pattern matched", "infra_y": "an infrastructure pattern matched or the vendor gave a severity"}
_TYPES = ["auth_bruteforce", "disk_pressure", "threat_x", "infra_y", "odd", "windows_audit_log_cleared"]
_VERDICTS = [("true", "critical"), ("true", "medium"), ("false", "info"), ("true", "critical"), ("false", "info"), ("true", "low")]
ORACLES = {
    "universal_formats": f"""
SELECT format, count(*) AS n FROM (SELECT {_list(KINDS)} AS format FROM events UNION ALL SELECT 'html' FROM pages WHERE trim(coalesce(html, '')) ILIKE '<!doctype html%' OR trim(coalesce(html, '')) ILIKE '<html%') GROUP BY 1""",
    "accepted_native": f"""
WITH e AS (SELECT *, n % 10 < CASE WHEN day(ts) % 2 = 0 THEN 6 ELSE 2 END AS bad FROM {_F}), g AS (SELECT run_id, count(*) AS t, count(*) FILTER (WHERE NOT bad) AS p FROM e GROUP BY 1)
SELECT run_id, CASE WHEN p >= t * 0.6 THEN 'canonical' ELSE 'generic' END AS format, CASE WHEN p >= t * 0.6 THEN p ELSE t END AS n FROM g""",
    "json_lines": f"""
WITH g AS (SELECT run_id, count(*) FILTER (WHERE n % 7 > 1) AS good, count(DISTINCT CASE WHEN n % 7 > 1 THEN host END) AS hosts, count(*) FILTER (WHERE n % 7 = 0) AS bad FROM {_F} GROUP BY 1)
SELECT run_id, nullif(good, 0) AS good, CASE WHEN good > 0 THEN hosts END AS hosts, nullif(bad, 0) AS bad FROM g WHERE good > 0 OR bad > 0""",
    "auth_csv": f"""
SELECT CASE event_type WHEN 'error' THEN 'auth_fail' WHEN 'purchase' THEN 'auth_ok' ELSE '-' END AS kind, CASE WHEN event_type IN ('error', 'purchase') THEN 'auth_csv' ELSE '-' END AS source, count(*) AS n,
  CASE WHEN any_value(event_type) IN ('error', 'purchase') THEN count(DISTINCT ip) ELSE 0 END AS ips, CAST(sum({_SEC}) AS BIGINT) AS sum_ts FROM {_F} WHERE n % 9 <> 0 GROUP BY 1, 2""",
    "log360_csv": f"""
SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'CRIT' END AS level, count(*) AS n, count(DISTINCT host) AS hosts, CAST(sum({_SEC}) AS BIGINT) AS sum_ts
FROM {_F} WHERE n % 11 <> 0 GROUP BY 1""",
    "windows_text": f"SELECT run_id, count(*) AS n, count(DISTINCT host) AS hosts, CAST(sum({_SEC}) AS BIGINT) AS sum_ts, count(*) AS whole FROM {_F} GROUP BY 1",
    "rule_predicates": f"SELECT type, predicate, count(*) AS n FROM (SELECT {_list(_TYPES)} AS type, ([{', '.join(_value(_PREDICATES.get(t)) for t in _TYPES)}])[event_id % 6 + 1] AS predicate FROM events) GROUP BY 1, 2",
    "stix_chain": """
WITH s AS (SELECT DISTINCT '10.9.' || (user_id % 6) || '.' || (event_id % 9) AS value FROM events),
m AS (SELECT value, s_suppkey, CASE WHEN s_suppkey % 4 <> 0 AND s_nationkey % 6 <> 0 THEN 'T' || s_nationkey END AS t FROM s JOIN supplier ON value = '10.9.' || (s_suppkey % 5) || '.' || (s_suppkey % 7))
SELECT value, count(*) AS indicators, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS techniques FROM m GROUP BY value""",
    "pattern_members": """SELECT 'h' || v AS value, count(*) AS indicators FROM (SELECT DISTINCT s_suppkey % 40 AS v FROM supplier), (SELECT DISTINCT s_suppkey AS k FROM supplier) WHERE contains('h' || k || '.net', 'h' || v) GROUP BY 1""",
    "contained_terms": """
WITH w AS (SELECT DISTINCT unnest(list_slice(regexp_extract_all(text, '[A-Za-z]{8,}'), 1, 3)) AS word FROM benchmark)
SELECT doc_id, count(*) AS sent, count(*) AS met FROM documents JOIN w ON contains(text, word) GROUP BY doc_id""",
    "restated_findings": """
WITH d AS (SELECT DISTINCT l_orderkey, l_partkey % 5 AS p FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l.l_orderkey, l_linenumber FROM lineitem l JOIN d ON d.l_orderkey = l.l_orderkey AND p = l_partkey % 5 WHERE l_quantity > 30)
SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS sum_run FROM lineitem l WHERE l_quantity > 30 AND NOT EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = l.l_orderkey AND h.l_linenumber = l.l_linenumber)""",
    "nse_verdicts": f"SELECT {_list(NSE_TEXT)} AS text, CAST({_list([v for v, _ in _VERDICTS])} AS BOOLEAN) AS vulnerable, {_list([s for _, s in _VERDICTS])} AS severity, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "dropped_true": """SELECT l_orderkey AS finding, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0""",
    "opinion_agreement": """
WITH o AS (SELECT CASE WHEN o_orderpriority < '3' THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN o_orderstatus = 'O' THEN 'HIGH' ELSE 'LOW' END AS o FROM orders)
SELECT severity, count(*) AS n, count(*) FILTER (WHERE o = severity) AS agree, count(*) FILTER (WHERE o <> severity) AS disagree FROM o GROUP BY 1""",
    "shared_entities": f"""
WITH v AS (SELECT lang, unnest(list_append(regexp_extract_all(coalesce(text, ''), '{P.IOC_IP}'), CAST(doc_id % 30 AS VARCHAR))) AS value FROM documents)
SELECT value FROM v WHERE lang = 'en' INTERSECT SELECT value FROM v WHERE lang = 'de'""",
    "run_headers": f"""
SELECT run_id, min({_SEC}) AS "first", max({_SEC}) AS "last", coalesce(string_agg(DISTINCT CASE WHEN user_id < 3 THEN host END, ',' ORDER BY CASE WHEN user_id < 3 THEN host END), '') AS hosts,
  count(*) FILTER (WHERE event_type = 'view') AS model, count(*) FILTER (WHERE event_type <> 'view') AS rules FROM {_F} GROUP BY 1""",
    "runbook_scan": """
WITH c AS (SELECT o_orderpriority AS runbook, o_orderkey AS i, o_totalprice > 300000 AS e, CASE WHEN o_totalprice > 300000 THEN '' WHEN o_orderstatus = 'O' THEN 'a,b' ELSE 'a' END AS m FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY runbook ORDER BY NOT e, length(m), i) AS k FROM c)
SELECT runbook, max(CASE WHEN k = 1 THEN i END) AS incident, bool_or(e) AS eligible, max(CASE WHEN k = 1 THEN m END) AS missing FROM k GROUP BY 1""",
    "audit_index": """
WITH o AS (SELECT o_custkey AS ledger, o_orderkey AS seq, sha256('{"seq":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS entry_hash FROM orders)
SELECT * FROM o WHERE ledger NOT IN (SELECT ledger FROM o WHERE seq % 50 = 3)""",
    "severity_order": f"""
SELECT lower(severity) AS severity, event_type AS type, n AS seq FROM {_F} WHERE run_id = 'day-2024-01-03'
ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, n LIMIT 60""",
    "case_timeline": f"SELECT run_id, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM {_F} WHERE event_type IN ('error', 'purchase') GROUP BY 1",
    "severity_mismatches": """
WITH o AS (SELECT o_orderkey AS entity, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS f FROM orders), x AS (SELECT *, CASE WHEN entity % 3 = 0 THEN 'HIGH' ELSE upper(f) END AS w FROM o)
SELECT entity, f AS found, w AS expected FROM x WHERE f <> lower(w)""",
    "incident_ids": f"""
WITH g AS (SELECT run_id, user_id AS entity, min(epoch_us(ts)) AS us, string_agg(CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS ids FROM {_F} GROUP BY 1, 2)
SELECT run_id, entity, 'inc-' || substr(sha1(run_id || '|' || entity || '|' || us || '|' || substr(sha1(ids), 1, 8)), 1, 12) AS incident_id FROM g""",
    "infrastructure_events": f"""
WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'interface ge-0/0/1 down' WHEN 'click' THEN 'power supply failed' WHEN 'view' THEN 'all quiet' ELSE 'link flapping' END AS t FROM events),
s AS (SELECT CASE WHEN event_id % 3 = 0 THEN '{P.STRUCTURED_SEVERITY['CRITICAL']}' WHEN regexp_matches(t, {_family(P.INFRA_CRITICAL)}) THEN 'critical' WHEN regexp_matches(t, {_family(P.INFRA_HIGH)}) THEN 'high' WHEN regexp_matches(t, {_family(P.INFRA_MEDIUM)}) THEN 'medium'
  WHEN regexp_matches(t, {_family(P.INFRA_LOW)}) THEN 'low' END AS severity FROM t)
SELECT severity, count(*) AS n FROM s WHERE severity IS NOT NULL GROUP BY 1""",
    "remapped_tokens": """
SELECT '[IP-' || CASE event_id % 30 WHEN 1 THEN 9 WHEN 9 THEN 1 WHEN 12 THEN 120 ELSE event_id % 30 END || '] seen' AS t, count(*) AS n FROM events GROUP BY 1""",
}
