"""Availability rules, enrichment, cases, views and triage features on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators import enrich, infra, intel, investigate, retrieval, score, triage
from loomwatch.plans.ingest import _events, _rx
from loomwatch.session import table
from loomwatch.sources.envelopes import lookup

ZK_TEXT = {
    "error": "Connection broken for id 188978561024, my id = 1", "click": "Send worker leaving thread", "view": "Interrupting SendWorker",
    "purchase": "Interrupted while waiting for message on queue", "signup": "Closed socket connection for client /10.0.0.1:1",
}


def _zk(spark, sf_dir):
    e = _events(spark, sf_dir)
    return infra.zookeeper(e.select("run_id", "n", lookup(ZK_TEXT, F.col("event_type")).alias("raw")))


def zookeeper_rules(spark, sf_dir):
    return _zk(spark, sf_dir).select("run_id", "rule", "hits", "severity", "first_n", "last_n", F.size("lines").alias("samples"))


def quorum_instability(spark, sf_dir):
    return infra.quorum_instability(_zk(spark, sf_dir)).select("run_id", "broken", "workers", "severity", "occurrences")


def servicing_groups(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.pmod("user_id", F.lit(3))
    msg = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed to open package [HRESULT = 0x800f080d - CBS_E_STORE_"), k.cast("string"), F.lit("]")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Warning:   slow   C:\\Windows\\x"), F.col("n").cast("string"), F.lit(".dll loaded")))
        .when(F.col("event_type") == "click", F.lit("unable to load [x]"))
        .otherwise(F.lit("Session started"))
    )
    r = e.select("run_id", "n", F.lit("INFO").alias("level"), F.when(k == 0, "CSI").otherwise("CBS").alias("channel"), msg.alias("msg"))
    return infra.servicing(r).select("run_id", "kind", "channel", "signature", "hits", "first_n", "last_n", "severity")


def infrastructure_text(spark, sf_dir):
    """The text families over web pages and documents: counts by severity."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("t"))
    e = _events(spark, sf_dir).select(F.concat(F.lit("interface ge-0/0/1 "), lookup({"error": "down", "click": "recovered", "view": "flapping"}, F.col("event_type"), F.lit("ok")), F.lit(" cpu 91 %")).alias("t"))
    return d.unionByName(e).groupBy(F.coalesce(infra.text_severity(F.col("t")), F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))


def username_spray(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type = 'error'")
    r = e.select(F.lit("r").alias("run_id"), "n", F.format_string("auth failed for user 'u%d' from 10.0.0.%d", F.pmod("n", F.lit(7)), F.pmod("user_id", F.lit(20))).alias("msg"))
    return enrich.username_spray(r).select("source", "distinct_usernames", F.array_join("sample", ",").alias("sample"))


def hydrated_evidence(spark, sf_dir):
    """Findings citing order lines, hydrated with the lines' text and the first host."""
    li = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    ev = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_linenumber").cast("string").alias("raw"), F.when(F.col("l_linenumber") >= 2, F.concat(F.lit("h"), F.col("l_linenumber").cast("string"))).alias("host"))
    cites = ev.select("run_id", F.lit("f").alias("finding"), F.col("n").alias("line"))
    d = enrich.hydrate(cites, ev, 3)
    return d.select("run_id", F.array_join("evidence", "|").alias("evidence"), "host")


def case_links(spark, sf_dir):
    """Orders as incidents, customers as cases that name some of their orders and one that does not exist."""
    o = table(spark, sf_dir, "orders")
    cases = o.filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_append(F.collect_set("o_orderkey"), -1 - F.first("o_custkey")).alias("incident_ids"))
    inc = o.select(F.col("o_orderkey").alias("incident_id"))
    both, orphans, fresh = enrich.attach_cases(inc, cases)
    a = both.agg(F.lit("linked").alias("kind"), F.count("cases").alias("n"))
    return a.unionByName(orphans.agg(F.lit("orphans").alias("kind"), F.count("*").alias("n"))).unionByName(fresh.agg(F.lit("new").alias("kind"), F.count("*").alias("n")))


def kill_chain(spark, sf_dir):
    tactic = lookup({"click": "Discovery", "view": "Reconnaissance", "signup": "Initial Access"}, F.col("event_type"))
    return enrich.kill_chain(table(spark, sf_dir, "events").select(tactic.alias("tactic"))).select("phase", "n", "ahead")


def entity_reach(spark, sf_dir):
    e = _events(spark, sf_dir)
    ev = e.select("run_id", "n", F.concat(F.lit("peer 10.1.1."), F.pmod("n", F.lit(9)).cast("string"), F.lit(" seen")).alias("raw"), F.concat(F.lit("h"), F.pmod("user_id", F.lit(5)).cast("string")).alias("host"))
    ent = ev.select(F.explode(F.array(F.lit("10.1.1.3"), F.lit("h2"))).alias("entity")).distinct()
    d = enrich.reach(investigate.footprint(ev, ent), ev)
    return d.select("entity", F.array_join("assets", ",").alias("assets"), "records", "first_n", "last_n")


def triage_features(spark, sf_dir):
    """Features of a user's day as a finding."""
    e = _events(spark, sf_dir)
    f = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.array_sort(F.collect_set(lookup({"error": "auth_bruteforce", "purchase": "windows_service_installed", "click": "threat_port_scan"}, F.col("event_type"), F.lit("other")))).alias("types"),
        F.collect_set("ip").alias("ips"), F.collect_list("n").alias("lines"), F.collect_list(F.unix_micros("ts")).alias("step_us"), F.count("*").alias("occurrences"),
    )
    empty = F.array().cast("array<string>")
    f = f.withColumns({"techniques": empty, "users": empty, "hosts": empty, "ports": empty, "criticality": F.when(F.col("user_id") % 2 == 0, "crown-jewel")})
    d = triage.features(f)
    return d.select("user_id", F.col("day").cast("string").alias("day"), "family_auth", "family_scan", "family_windows", "family_other", F.col("f_rules").alias("rules"), F.col("f_ips").alias("ips"), F.col("f_occurrences").alias("occurrences"), F.round("f_span_s", 3).alias("span_s"), F.round("f_per_minute", 6).alias("per_minute"), F.col("f_timed").alias("timed"), F.col("f_criticality").alias("criticality"))


def triage_folds(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    d = triage.class_weights(triage.folds(lab))
    return d.groupBy("label", "fold").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


def confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    hit = F.when(F.col("text").rlike(r"(?i)\b(idiot|moron|pathetic|worthless|stupid)\b"), 1).otherwise(0)
    return triage.confusion_scores(d.select(F.col("toxic").alias("label"), hit.alias("opinion")))


def vulnerability_bands(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.format_string("found CVE-20%02d-%04d %.1f and CVE-2001-1234", F.pmod("l_partkey", F.lit(20)), F.col("l_suppkey") + 1000, F.pmod("l_orderkey", F.lit(100)) / 10)
    v = intel.vulnerabilities(li.select(F.col("l_orderkey").alias("ip"), text.alias("output")))
    return v.groupBy("band").agg(F.count("*").alias("n"), F.round(F.max("cvss"), 1).alias("worst"))


def finding_overlap(spark, sf_dir):
    """Orders of even number as rule findings, of odd number as a model's: a part in equal quantity is a shared address, a supplier on one day a shared line (every third
    customer cites lines), the customer the host."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.upper(F.substring("o_orderpriority", 3, 20)).alias("p"))
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("id"))
    line = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.concat_ws("-", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")))
    sev = F.when(F.col("p") == "URGENT", "CRITICAL").when(F.col("p") == "NOT SPECIFIED", "INFO").otherwise(F.col("p"))
    per = li.groupBy("id", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("host"), sev.alias("severity")).agg(
        F.collect_set(F.concat_ws("-", "l_partkey", F.col("l_quantity").cast("int"))).alias("ips"), F.collect_set(line).alias("lines")
    )
    return score.align(per.filter("id % 2 = 0"), per.filter("id % 2 = 1").withColumn("hosts", F.array("host")))


def page_terms(spark, sf_dir):
    """Most frequent words over all pages."""
    w = retrieval.words(table(spark, sf_dir, "pages"), "page_id", "html")
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(25)


QUERIES = {f.__name__: f for f in (
    zookeeper_rules, quorum_instability, servicing_groups, infrastructure_text, username_spray, hydrated_evidence, case_links, kill_chain, entity_reach, triage_features,
    triage_folds, confusion, vulnerability_bands, finding_overlap, page_terms,
)}

_DAY = "'day-' || strftime(ts, '%Y-%m-%d')"
_ZK = f"""WITH z AS (SELECT {_DAY} AS run_id, event_id AS n, CASE event_type WHEN 'error' THEN 'zookeeper_connection_broken' WHEN 'click' THEN 'zookeeper_sendworker_exit'
  WHEN 'view' THEN 'zookeeper_sendworker_interrupt' WHEN 'purchase' THEN 'zookeeper_sendworker_interrupted' ELSE 'zookeeper_socket_closed' END AS rule FROM events),
g AS (SELECT run_id, rule, count(*) AS hits, min(n) AS first_n, max(n) AS last_n FROM z GROUP BY 1, 2)"""
_ZKSEV = "CASE " + " ".join(f"WHEN rule = '{r}' AND hits >= {least} THEN '{s}'" for r, _, steps in P.ZOOKEEPER_RULES for least, s in steps) + " END"


def _any(rules: list[str]) -> str:
    return _rx("|".join(f"(?:{r})" for r in rules))


ORACLES = {
    "zookeeper_rules": f"{_ZK} SELECT run_id, rule, hits, {_ZKSEV} AS severity, first_n, last_n, CAST(least(hits, 8) AS INTEGER) AS samples FROM g",
    "quorum_instability": f"""{_ZK}, q AS (SELECT run_id, CAST(sum(CASE WHEN rule = 'zookeeper_connection_broken' THEN hits ELSE 0 END) AS BIGINT) AS broken,
  CAST(sum(CASE WHEN rule LIKE 'zookeeper_sendworker%' THEN hits ELSE 0 END) AS BIGINT) AS workers FROM g GROUP BY 1)
SELECT run_id, broken, workers, CASE WHEN broken >= 20 AND workers >= 20 THEN 'CRITICAL' WHEN broken >= 5 AND workers >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, broken + workers AS occurrences
FROM q WHERE broken > 0 AND workers > 0""",
    "servicing_groups": f"""
WITH e AS (SELECT {_DAY} AS run_id, event_id AS n, event_type AS t, CASE WHEN user_id % 3 = 0 THEN 'CSI' ELSE 'CBS' END AS channel, user_id % 3 AS k FROM events WHERE event_type IN ('error', 'view', 'click')),
s AS (SELECT *, CASE t WHEN 'error' THEN 'hresult' WHEN 'view' THEN 'warning' ELSE 'failure' END AS kind,
  CASE t WHEN 'error' THEN 'CBS_E_STORE_' || k WHEN 'view' THEN 'Warning: slow <path> loaded' ELSE 'unable to load [x' END AS signature FROM e)
SELECT run_id, kind, channel, signature, count(*) AS hits, min(n) AS first_n, max(n) AS last_n,
  CASE kind WHEN 'hresult' THEN CASE WHEN count(*) >= 10 THEN 'high' ELSE 'medium' END WHEN 'warning' THEN 'low' ELSE 'medium' END AS severity FROM s GROUP BY 1, 2, 3, 4""",
    "infrastructure_text": f"""
WITH t AS (SELECT coalesce(text, '') AS t FROM documents UNION ALL
  SELECT 'interface ge-0/0/1 ' || CASE event_type WHEN 'error' THEN 'down' WHEN 'click' THEN 'recovered' WHEN 'view' THEN 'flapping' ELSE 'ok' END || ' cpu 91 %' FROM events),
a AS (SELECT regexp_replace(t, '[^\\x00-\\x7F]', 'x', 'g') AS t FROM t)
SELECT CASE WHEN regexp_matches(t, {_any(P.INFRA_CRITICAL)}) THEN 'critical' WHEN regexp_matches(t, {_any(P.INFRA_HIGH)}) THEN 'high'
  WHEN regexp_matches(t, {_any(P.INFRA_MEDIUM)}) THEN 'medium' WHEN regexp_matches(t, {_any(P.INFRA_LOW)}) THEN 'low' ELSE 'none' END AS severity, count(*) AS n FROM a GROUP BY 1""",
    "username_spray": """
WITH f AS (SELECT '10.0.0.' || (user_id % 20) AS source, 'u' || (event_id % 7) AS u, min(event_id) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, u) AS k FROM f)
SELECT source, count(*) AS distinct_usernames, string_agg(CASE WHEN k <= 4 THEN u END, ',' ORDER BY k) AS sample FROM k GROUP BY source""",
    "hydrated_evidence": """
WITH l AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS n FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) AS k FROM l)
SELECT run_id, string_agg(CAST(n AS VARCHAR), '|' ORDER BY n) AS evidence, 'h' || min(CASE WHEN n >= 2 THEN n END) AS host FROM k WHERE k <= 3 GROUP BY run_id""",
    "case_links": """
SELECT 'linked' AS kind, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT 'orphans', count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT 'new', count(*) FROM orders WHERE o_custkey % 3 <> 0""",
    "kill_chain": """
WITH c AS (SELECT CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 0 WHEN 'signup' THEN 1 END AS o, count(*) AS n FROM events GROUP BY 1),
d(o, phase) AS (VALUES (0, 'Planning / Probing'), (1, 'Breaking In'), (2, 'Spreading Inside'), (3, 'Damaging / Stealing'))
SELECT phase, coalesce(n, 0) AS n, d.o > (SELECT max(o) FROM c) AS ahead FROM d LEFT JOIN c ON c.o = d.o""",
    "entity_reach": """
WITH e AS (SELECT event_id AS n, 'h' || (user_id % 5) AS host, event_id % 9 AS p FROM events),
f AS (SELECT '10.1.1.3' AS entity, * FROM e WHERE p = 3 UNION ALL SELECT 'h2', * FROM e WHERE host = 'h2')
SELECT entity, string_agg(DISTINCT host, ',' ORDER BY host) AS assets, count(*) AS records, min(n) AS first_n, max(n) AS last_n FROM f GROUP BY entity""",
    "triage_features": """
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, epoch_us(ts) AS us, '10.' || (user_id % 200) || '.' || (event_id % 250) || '.7' AS ip FROM events),
g AS (SELECT user_id, day, bool_or(event_type = 'error') AS a, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS w, bool_or(event_type IN ('view', 'signup')) AS o,
  count(DISTINCT ip) AS ips, count(*) AS n, (max(us) - min(us)) / 1e6 AS span FROM e GROUP BY 1, 2)
SELECT user_id, day, CAST(a AS DOUBLE) AS family_auth, CAST(c AS DOUBLE) AS family_scan, CAST(w AND NOT a AND NOT c AND NOT (o AND FALSE) AND NOT o AS DOUBLE) AS family_windows,
  CAST(NOT a AND NOT c AND NOT (w AND NOT o) AS DOUBLE) AS family_other, CAST(CAST(a AS INT) + CAST(c AS INT) + CAST(w AS INT) + CAST(o AS INT) AS DOUBLE) AS rules, CAST(ips AS DOUBLE) AS ips,
  CAST(n AS DOUBLE) AS occurrences, round(CASE WHEN n >= 2 THEN span ELSE 0 END, 3) AS span_s, round(CASE WHEN n >= 2 AND span > 0 THEN n / (span / 60.0) ELSE 0 END, 6) AS per_minute,
  CAST(n >= 2 AS DOUBLE) AS timed, CAST(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS criticality FROM g""",
    "triage_folds": """
WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c)
SELECT label, CAST(f AS INTEGER) AS fold, CAST(n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n, round(t / (k * n), 9) AS weight FROM c, t, range(5) r(f) WHERE n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END > 0""",
    "confusion": r"""
WITH x AS (SELECT toxic AS a, CAST(regexp_matches(text, '(?i)\b(idiot|moron|pathetic|worthless|stupid)\b') AS INTEGER) AS b FROM documents JOIN labels USING (doc_id)),
c AS (SELECT k, count(*) FILTER (WHERE a = k AND b = k) AS tp, count(*) FILTER (WHERE a <> k AND b = k) AS fp, count(*) FILTER (WHERE a = k AND b <> k) AS fn FROM x, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT round(sum(CASE WHEN a = b THEN 1 ELSE 0 END) / count(*), 4) AS accuracy, count(*) AS "rows", (SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 4) FROM c) AS macro_f1 FROM x""",
    "vulnerability_bands": """
WITH l AS (SELECT DISTINCT l_orderkey AS ip, 'CVE-20' || lpad(CAST(l_partkey % 20 AS VARCHAR), 2, '0') || '-' || (l_suppkey + 1000) AS cve, (l_orderkey % 100) / 10 AS cvss FROM lineitem
 UNION SELECT l_orderkey, 'CVE-2001-1234', NULL FROM lineitem),
m AS (SELECT ip, cve, max(cvss) AS cvss FROM l GROUP BY 1, 2)
SELECT CASE WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' WHEN cvss >= 4 THEN 'MEDIUM' WHEN cvss > 0 THEN 'LOW' ELSE 'INFO' END AS band, count(*) AS n, round(max(cvss), 1) AS worst FROM m GROUP BY 1""",
    "finding_overlap": """
WITH l AS (SELECT l_orderkey AS id, o_custkey AS c, upper(substr(o_orderpriority, 3)) AS p, 'p' || l_partkey || '-' || CAST(l_quantity AS INTEGER) AS a, 's' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m-%d') AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT id, any_value(c) AS c, CASE any_value(p) WHEN 'URGENT' THEN 'CRITICAL' WHEN 'NOT SPECIFIED' THEN 'INFO' ELSE any_value(p) END AS sev, CASE any_value(p) WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS r FROM l GROUP BY id),
v AS (SELECT DISTINCT id, a AS k FROM l UNION SELECT id, b FROM l WHERE c % 3 = 0),
m AS (SELECT DISTINCT a.id, b.id AS mid FROM v a JOIN v b ON a.k = b.k AND a.id % 2 = 0 AND b.id % 2 = 1 UNION SELECT a.id, b.id FROM o a JOIN o b ON a.c = b.c AND a.id % 2 = 0 AND b.id % 2 = 1 WHERE a.c % 3 <> 0),
k AS (SELECT m.id, min(o.r * 1000000000000 + o.id) AS k FROM m JOIN o ON o.id = m.mid GROUP BY 1)
SELECT o.id, x.id AS model_id, coalesce(x.sev, 'MISSED') AS model_severity, CASE WHEN coalesce(x.r, 5) > o.r THEN 'under-rated' WHEN x.r < o.r THEN 'over-rated' ELSE 'agree' END AS delta
FROM o LEFT JOIN k USING (id) LEFT JOIN o x ON x.id = k.k % 1000000000000 WHERE o.id % 2 = 0""",
    "page_terms": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '[a-z0-9]+')) AS term FROM pages) GROUP BY term ORDER BY n DESC, term LIMIT 25",
}
