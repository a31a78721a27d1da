"""Incidents, priorities, rollups, precedents and scores on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators import incidents as I, investigate, ledger, lifecycle, redact, retrieval, rollups, rules, runbooks, score
from loomwatch.session import table
from loomwatch.sources import sinks
from loomwatch.sources.envelopes import lookup

HOUR = 3_600_000_000
SEV = {"error": "HIGH", "purchase": "MEDIUM", "click": "LOW", "view": "INFO", "signup": "CRITICAL"}
_SEV = "CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'INFO' ELSE 'CRITICAL' END"
_RANK = "CASE {} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("run").alias("run_id"), F.col("user_id").alias("entity"), F.unix_micros("ts").alias("us"), F.col("event_id").alias("seq"), F.col("event_id").alias("id"),
        lookup(SEV, F.col("event_type")).alias("severity"), F.col("event_type").alias("type"), "ts",
    )


def error_burst(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("all").alias("run_id"), F.col("event_id").alias("n"), F.unix_micros("ts").alias("us"))
    return rules.error_bursts(e, HOUR // 2, 5).select("start_n", "end_n", "count")


def incident_sessions(spark, sf_dir):
    d = I.incidents(I.rolled_up(I.sessions(_findings(spark, sf_dir), 6 * HOUR)))
    return d.select("entity", "cluster", "severity", "findings", "first_us", "last_us", F.array_join("types", ",").alias("types"), F.sha1(F.array_join("finding_ids", ",")).alias("ids_sha1"))


def incident_priority(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sev = lookup({"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "4-NOT SPECIFIED": "LOW", "5-LOW": "INFO"}, F.col("o_orderpriority"))
    crit = F.when(F.col("c_mktsegment") == "BUILDING", "crown-jewel").when(F.col("c_mktsegment") == "MACHINERY", "low")
    d = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", sev.alias("severity"), crit.alias("criticality"))
    return I.priority(d).groupBy("severity", "priority").agg(F.count("*").alias("n"))


def attacker_phase(spark, sf_dir):
    f = _findings(spark, sf_dir)
    tactic = lookup({"error": "Credential Access", "purchase": "Impact", "click": "Discovery", "view": "Reconnaissance", "signup": "Initial Access"}, F.col("type"))
    per = f.withColumn("tactic", tactic).groupBy("entity", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("tactic").alias("t"))
    return per.select("entity", "day", I.phase(F.col("t")).alias("phase"))


def severity_donut(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rollups.severity_counts(f, ["day"]).select(F.col("day").cast("string").alias("day"), "severity", "n", F.round("pct", 1).alias("pct"))


def alerts_per_hour(spark, sf_dir):
    d = rollups.per_hour(_findings(spark, sf_dir), "ts", "severity", list(P.SEVERITY_RANK))
    return d.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), *(F.col(s).alias(s.lower()) for s in P.SEVERITY_RANK))


def runs_summary(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rollups.runs_summary(f, "day", {"findings": F.count("*"), "entities": F.count_distinct("entity"), "critical": F.count_if(F.col("severity") == "CRITICAL")})


def run_delta(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("severity", "day").agg(F.count("*").alias("n"))
    return rollups.change(f, ["severity"], "day", "n").select("severity", "day", "n", "previous", F.round("change_pct", 0).alias("change_pct"))


def attempt_series(spark, sf_dir):
    f = _findings(spark, sf_dir).filter("type = 'error'").groupBy("entity", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return rollups.attempts(f, "entity", "day", "n").select("entity", "points", F.round("mean", 6).alias("mean"), "first", "latest", "change", "direction")


def asset_risk(spark, sf_dir):
    li, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    sev = F.when(F.col("l_returnflag") == "R", "HIGH").when(F.col("l_returnflag") == "A", "MEDIUM")
    crit = F.when(F.col("n_regionkey") == 0, "crown-jewel").when(F.col("n_regionkey") == 1, "low")
    d = li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    d = d.select("n_name", sev.alias("severity"), crit.alias("criticality"), F.unix_micros("l_shipdate").alias("us"))
    return rollups.risk(d, ["n_name"]).select("n_name", "events", "findings", F.round("risk", 1).alias("risk"), "worst", "last_us")


def mean_time(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    d = o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderpriority", F.unix_seconds("o_orderdate").alias("a"), F.unix_seconds("l_shipdate").alias("b"))
    return rollups.mean_gap(d, F.col("a"), F.col("b"), ["o_orderpriority"]).select("o_orderpriority", F.round("mean", 3).alias("mean"), "pairs")


def technique_frequency(spark, sf_dir):
    f = _findings(spark, sf_dir)
    kinds = {"error": "auth_bruteforce", "purchase": "threat_port_scan", "click": "ioc_observed", "view": "suspicious_outbound", "signup": "threat_ransomware"}
    d = I.with_techniques(f.withColumn("type", lookup(kinds, F.col("type"))))
    return d.groupBy(F.coalesce("technique_id", F.lit("-")).alias("technique"), F.coalesce("tactic", F.lit("-")).alias("tactic")).agg(F.count("*").alias("n"))


def store_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = rollups.store_query(e, {"event_type": "error", "no_such": "x"}, '"k": 7', ["props"])
    return rollups.page(d, [F.desc("ts"), F.desc("event_id")], 50, 10).select("event_id", "user_id", "props")


def bm25(spark, sf_dir):
    """Documents ranked for each benchmark passage: the best one that passes the bars."""
    q = retrieval.words(table(spark, sf_dir, "benchmark"), "item_id", "text")
    d = retrieval.cite(retrieval.best_documents(table(spark, sf_dir, "documents"), "doc_id", "text", q))
    return d.select("query", "doc", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def cited_passages(spark, sf_dir):
    """The best document of each benchmark passage's first twenty words, and its paragraph that holds most of them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q = retrieval.words(table(spark, sf_dir, "benchmark").withColumn("text", F.substring_index(F.regexp_replace("text", "[^A-Za-z0-9]+", " "), " ", 20)), "item_id", "text")
    best = retrieval.cite(retrieval.best_documents(d, "id", "text", q), 0.0, 0.0)
    return retrieval.passages(best, d, q, "text").select("query", "doc", F.sha2("passage", 256).alias("passage_sha256"))


def precedents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("id"), F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))).alias("dim", "value"))
    d = retrieval.precedents(t, p.select(F.col("p_partkey").alias("id")).filter("id % 20 = 0"), 10)
    return d.select("id", "other", "overlap", "dimensions", "rank")


def set_score(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hit = d.join(lab, "doc_id").filter(F.col("text").rlike(r"(?i)\b(idiot|moron|pathetic|worthless|stupid)\b")).select("doc_id", "lang")
    want = d.join(lab.filter("toxic = 1"), "doc_id").select("doc_id", "lang")
    return score.set_score(hit, want, ["doc_id", "lang"], ["lang"])


def _cited(spark, sf_dir):
    """Rules cite ranges of lines (order lines) and quote one more verbatim; labelled lines are those returned."""
    li = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    quote = F.concat(F.lit("seen: <order line "), F.col("line") + 5, F.lit("> and more"))
    f = li.filter("l_quantity > 45").select(
        F.col("l_linestatus").alias("rule_id"), F.col("l_linestatus").alias("format"), F.col("line").alias("finding"), F.col("line").alias("lo"), (F.col("line") + 2).alias("hi"), quote.alias("evidence")
    )
    return f, li.filter("l_returnflag = 'R'").select(F.col("l_linestatus").alias("format"), "line", F.concat(F.lit(" <order line "), "line", F.lit(">")).alias("raw"))


def scorecard(spark, sf_dir):
    f, lab = _cited(spark, sf_dir)
    return score.scorecard(f, score.cited_hits(f, lab), lab)


def score_misses(spark, sf_dir):
    """What the scorecard's rules missed and what they flagged in vain, by line status and in total, the first three verbatim."""
    f, lab = _cited(spark, sf_dir)
    d = score.misses(f.select("format", "finding", "evidence").distinct(), score.cited_hits(f, lab), lab.distinct(), "format", 3)
    return d.select("format", "kind", "n", F.array_join("samples", "|").alias("samples"))


def chunk_findings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    d = score.chunks(li.withColumn("n", F.col("l_partkey")), "n", ["l_returnflag"], 25)
    return d.select("l_returnflag", "chunk", "findings", "first_line", "last_line")


def hash_chain(spark, sf_dir):
    """A chain of digests per customer over its orders; one order in a hundred was altered after hashing."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ledger"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    text = lambda status: F.sha2(F.concat_ws("|", "seq", status), 256)
    d = o.withColumn("entry_hash", text(F.col("status"))).withColumn("prev_hash", F.lag("entry_hash").over(W.partitionBy("ledger").orderBy("seq")))
    d = d.withColumn("status", F.when(F.col("seq") % 100 == 3, "X").otherwise(F.col("status")))
    return ledger.verify_chain(d, "ledger", "seq", "prev_hash", "entry_hash", text(F.col("status")))


def lifecycle_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    to = lookup({"click": "acknowledged", "purchase": "resolved", "error": "reopened", "signup": "open"}, F.col("event_type"))
    t = e.select(F.col("user_id").alias("incident"), F.col("event_id").alias("seq"), to.alias("to"), F.unix_seconds("ts").alias("at")).filter("to is not null")
    return lifecycle.lifecycle(t)


def runbook_eligibility(spark, sf_dir):
    """A user's day is an incident."""
    f = _findings(spark, sf_dir)
    per = f.groupBy((F.col("entity") * 100_000 + F.unix_date(F.to_date("ts"))).alias("incident")).agg(
        F.collect_set("type").alias("types"), F.min_by("severity", I.severity_rank(F.col("severity"))).alias("severity"),
        F.array_compact(F.array(F.when(F.count("*") >= 5, "many"), F.when(F.count_if(F.col("type") == "error") >= 2, "errors"))).alias("evidence"),
    )
    per = per.withColumn("entity_kind", F.when(F.col("incident") % 2 == 0, "user").otherwise("host"))
    books = spark.createDataFrame([("rb-user", ["error"], ["user"], ["errors"], "HIGH"), ("rb-any", ["signup", "error"], ["user", "host"], ["errors", "many"], "MEDIUM")], runbooks.RUNBOOK)
    return runbooks.eligibility(per, books).select("incident", "runbook", F.array_join("missing", ",").alias("missing"), "eligible")


def _attacked(spark, sf_dir):
    """Conversations as lines of an attack: each turn ends with addresses, one of them in a user name's place, and names."""
    tail = F.format_string(" from 10.0.%d.%d by fe80:0:0:%d:a:b:c:d Failed password for invalid user 10.0.%d.9 port 22 user=%s", F.pmod("conv_id", F.lit(200)), "turn", "turn", F.pmod("conv_id", F.lit(7)), "role")
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", tail))


def redaction(spark, sf_dir):
    return redact.redact(_attacked(spark, sf_dir), "conv_id", "turn", "text").select("conv_id", "turn", "redacted")


def redaction_known(spark, sf_dir):
    """All events of a type are a scope; their hosts and some users are known by name, and masked wherever they stand."""
    e = table(spark, sf_dir, "events")
    line = F.format_string("db-%d.example app-%d started by svc_%d; app-%d.b see user=%d", F.pmod("user_id", F.lit(50)), F.pmod("event_id", F.lit(90)), F.pmod("event_id", F.lit(30)), F.pmod("event_id", F.lit(90)), "user_id")
    lines = e.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("n"), line.alias("text"), F.format_string("db-%d.example", F.pmod("user_id", F.lit(50))).alias("host"))
    found = e.select(F.col("event_type").alias("run_id"), F.format_string("app-%d", F.pmod("event_id", F.lit(90))).alias("host"), F.lit(True).alias("host_derived"), F.format_string("svc_%d", F.pmod("event_id", F.lit(30))).alias("user"), F.lit(None).cast("array<string>").alias("usernames"))
    return redact.redact(lines, "run_id", "n", "text", redact.LINE_CAP, redact.seeds(found, lines)).select("run_id", "n", "redacted")


def redaction_tokens(spark, sf_dir):
    """Addresses per source, numbered by first appearance."""
    return redact.token_table(table(spark, sf_dir, "documents"), "source", "doc_id", "text").filter(F.col("kind") == "IP").select("scope", "value", "token")


def milestones(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("r").alias("run_id"), F.col("user_id").alias("source"), F.col("event_id").alias("n"), F.unix_micros("ts").alias("us"), "event_type")
    d = investigate.milestones(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), 5, 24 * HOUR)
    return d.select("source", "step", "n", "us")


def event_findings(spark, sf_dir):
    """Each line with the first finding that cites it."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("n"), "l_quantity", "l_partkey")
    c = li.filter("l_quantity >= 40").select("run_id", F.col("l_partkey").alias("finding"), F.col("n").alias("seq"), F.explode(F.sequence(F.col("n"), F.col("n") + 1)).alias("line"))
    d = investigate.lines_to_findings(li.select("run_id", "n"), c)
    return d.groupBy("is_finding").agg(F.count("*").alias("lines"), F.sum("finding").alias("sum_finding"))


def event_hash_dedupe(spark, sf_dir):
    """Rows that the store does not hold yet, by hash; the store holds every third order."""
    o = table(spark, sf_dir, "orders")
    h = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256)
    new = o.unionByName(o.filter("o_orderkey % 7 = 0")).withColumn("event_hash", h)
    held = o.filter("o_orderkey % 3 = 0").select(h.alias("event_hash"))
    return sinks.new_rows(new, held, "event_hash", ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("new_rows"))


QUERIES = {f.__name__: f for f in (
    error_burst, incident_sessions, incident_priority, attacker_phase, severity_donut, alerts_per_hour, runs_summary, run_delta, attempt_series, asset_risk,
    mean_time, technique_frequency, store_query, bm25, cited_passages, precedents, set_score, scorecard, score_misses, chunk_findings, hash_chain, lifecycle_fold, runbook_eligibility,
    redaction, redaction_known, redaction_tokens, milestones, event_findings, event_hash_dedupe,
)}

_CITED = """l AS (SELECT *, l_orderkey * 10 + l_linenumber AS line FROM lineitem), lab AS (SELECT DISTINCT line FROM l WHERE l_returnflag = 'R'),
c AS (SELECT l_linestatus AS rule_id, line AS finding, unnest([line, line + 1, line + 2, line + 5]) AS line FROM l WHERE l_quantity > 45),
j AS (SELECT c.*, lab.line IS NOT NULL AS hit FROM c LEFT JOIN lab USING (line)),"""


def _mark(text: str) -> str:
    """Marks of ``text`` as redaction sets them, without look-around."""
    put = lambda kind, k: f"'{k[0]}' || chr(1) || '{kind}{k[1]}' || chr(2) || '{k[2]}'"
    out = f"regexp_replace({text}, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')"
    for rx in (P.IOC_IP, P.IPV6):
        out = f"regexp_replace({out}, '({rx})', {put('I', ('', chr(92) + '1', ''))}, 'g')"
    for rx in (r"(user '')([^''\x01\x02]+)('')", r"(for '')([^''\x01\x02]+)('')", r"(\b(?:Failed|Accepted)\s+\S+\s+for\s+(?:invalid user\s+)?)([A-Za-z0-9._$-]+)()",
               r"(\bfor user\s+)([A-Za-z0-9._$-]+)()", r"(\buser=)([A-Za-z0-9._$-]+)()", r"(\binvalid user\s+)([A-Za-z0-9._$-]+)()"):
        out = f"regexp_replace({out}, '{rx}', {put('U', (chr(92) + '1', chr(92) + '2', chr(92) + '3'))}, 'g')"
    return out


def _redacted(marks: str, scope: str, order: str) -> str:
    """SQL of the redacted texts of ``marks`` (scope, order, m)."""
    return f"""p AS (SELECT {scope}, {order}, unnest(string_split_regex(m, '[\\x01\\x02]')) AS p, unnest(range(len(string_split_regex(m, '[\\x01\\x02]')))) AS i FROM {marks}),
v AS (SELECT {scope}, p, min({order} * 1000000 + i) AS k FROM p WHERE i % 2 = 1 GROUP BY 1, 2),
t AS (SELECT {scope}, p, CASE p[1] WHEN 'I' THEN '[IP-' WHEN 'U' THEN '[USER-' ELSE '[HOST-' END || row_number() OVER (PARTITION BY {scope}, p[1] ORDER BY k, p) || ']' AS token FROM v)
SELECT p.{scope}, p.{order}, string_agg(CASE WHEN i % 2 = 1 THEN token ELSE p.p END, '' ORDER BY i) AS redacted FROM p LEFT JOIN t ON t.{scope} = p.{scope} AND t.p = p.p AND i % 2 = 1 GROUP BY 1, 2"""


_TURN = "text || ' from 10.0.' || (conv_id % 200) || '.' || turn || ' by fe80:0:0:' || turn || ':a:b:c:d Failed password for invalid user 10.0.' || (conv_id % 7) || '.9 port 22 user=' || role"

ORACLES = {
    "redaction": f"WITH m AS (SELECT conv_id, turn, {_mark(_TURN)} AS m FROM conversations), {_redacted('m', 'conv_id', 'turn')}",
    "redaction_known": f"""
WITH m AS (SELECT event_type AS run_id, event_id AS n, chr(1) || 'Hdb-' || (user_id % 50) || '.example' || chr(2) || ' ' || chr(1) || 'Happ-' || (event_id % 90) || chr(2) || ' started by ' || chr(1) || 'Usvc_' || (event_id % 30) || chr(2)
  || '; ' || chr(1) || 'Happ-' || (event_id % 90) || chr(2) || '.b see user=' || chr(1) || 'U' || user_id || chr(2) AS m FROM events), {_redacted('m', 'run_id', 'n')}""",
    "error_burst": """
WITH RECURSIVE e AS (SELECT event_id AS n, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
c AS (SELECT n, us, (SELECT count(*) FROM e b WHERE b.us BETWEEN a.us AND a.us + 1800000000 AND (b.us > a.us OR b.n >= a.n)) AS c,
      (SELECT max(b.n) FROM e b WHERE b.us BETWEEN a.us AND a.us + 1800000000) AS z FROM e a),
w AS (SELECT *, row_number() OVER (ORDER BY us, n) AS i FROM c WHERE c >= 5),
g AS (SELECT i, n, z, c FROM w WHERE i = 1 UNION ALL
      SELECT x.i, x.n, x.z, x.c FROM g, LATERAL (SELECT * FROM w WHERE w.i > g.i AND w.n > g.z ORDER BY w.i LIMIT 1) x)
SELECT n AS start_n, z AS end_n, c AS count FROM g""",
    "incident_sessions": f"""
WITH f AS (SELECT user_id AS entity, epoch_us(ts) AS us, event_id AS id, {_SEV} AS severity, event_type FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity ORDER BY us, id) > 21600000000 THEN 1 ELSE 0 END AS x FROM f),
c AS (SELECT *, sum(x) OVER (PARTITION BY entity ORDER BY us, id) AS cluster FROM g),
m AS (SELECT *, count(*) OVER (PARTITION BY entity, cluster) = 1 AND severity IN ('LOW', 'INFO') AS minor FROM c),
r AS (SELECT *, CASE WHEN minor AND count(*) FILTER (WHERE minor) OVER (PARTITION BY entity) > 1 THEN -1 ELSE cluster END AS k FROM m)
SELECT entity, CAST(k AS BIGINT) AS cluster, arg_min(severity, {_RANK.format('severity')}) AS severity, count(*) AS findings, min(us) AS first_us, max(us) AS last_us,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))) AS ids_sha1
FROM r GROUP BY entity, k""",
    "incident_priority": """
WITH d AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN 'LOW' WHEN '5-LOW' THEN 'INFO' END AS severity,
  CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 0 ELSE 1 END AS c FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT severity, CASE severity WHEN 'CRITICAL' THEN CASE c WHEN 0 THEN 'P2' ELSE 'P1' END WHEN 'HIGH' THEN CASE c WHEN 2 THEN 'P1' WHEN 1 THEN 'P2' ELSE 'P3' END
  WHEN 'MEDIUM' THEN CASE c WHEN 2 THEN 'P2' WHEN 1 THEN 'P3' ELSE 'P4' END WHEN 'LOW' THEN CASE c WHEN 2 THEN 'P3' ELSE 'P4' END WHEN 'INFO' THEN 'P4' END AS priority, count(*) AS n
FROM d GROUP BY 1, 2""",
    "attacker_phase": """
WITH f AS (SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS p FROM events)
SELECT entity, day, CASE max(p) WHEN 0 THEN 'Planning / Probing' WHEN 1 THEN 'Breaking In' WHEN 2 THEN 'Spreading Inside' ELSE 'Damaging / Stealing' END AS phase FROM f GROUP BY entity, day""",
    "severity_donut": f"""
WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {_SEV} AS severity FROM events),
s(severity) AS (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')),
n AS (SELECT d.day, s.severity, count(f.day) AS n FROM (SELECT DISTINCT day FROM f) d CROSS JOIN s LEFT JOIN f ON f.day = d.day AND f.severity = s.severity GROUP BY 1, 2)
SELECT day, severity, n, round_even(n * 100.0 / sum(n) OVER (PARTITION BY day), 1) AS pct FROM n""",
    "alerts_per_hour": """
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) FILTER (WHERE event_type = 'signup') AS critical, count(*) FILTER (WHERE event_type = 'error') AS high,
  count(*) FILTER (WHERE event_type = 'purchase') AS medium, count(*) FILTER (WHERE event_type = 'click') AS low, count(*) FILTER (WHERE event_type = 'view') AS info FROM events GROUP BY 1""",
    "runs_summary": """
SELECT day, count(*) AS findings, count(DISTINCT user_id) AS entities, count(*) FILTER (WHERE event_type = 'signup') AS critical
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY ROLLUP (day)""",
    "run_delta": f"""
WITH f AS (SELECT {_SEV} AS severity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(n) OVER (PARTITION BY severity ORDER BY day) AS previous FROM f)
SELECT severity, day, n, previous, CASE WHEN previous <> 0 THEN round_even(abs(n - previous) * 100.0 / previous, 0) END AS change_pct FROM p""",
    "attempt_series": """
WITH f AS (SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS k FROM f)
SELECT entity, count(*) AS points, round(avg(n), 6) AS mean, arg_max(n, k) AS first, arg_min(n, k) AS latest, CASE WHEN count(*) >= 2 THEN arg_min(n, k) - arg_max(n, k) END AS change,
  CASE WHEN count(*) < 2 THEN NULL WHEN arg_min(n, k) > arg_max(n, k) THEN 'up' WHEN arg_min(n, k) < arg_max(n, k) THEN 'down' ELSE 'flat' END AS direction FROM k WHERE k <= 7 GROUP BY entity""",
    "asset_risk": """
WITH d AS (SELECT n_name, CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 2 END AS w, CASE n_regionkey WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS c, epoch_us(l_shipdate) AS us
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name, count(*) AS events, count(w) AS findings, CAST(round(sum(coalesce(w * c, 0)), 1) AS DOUBLE) AS risk, CASE max(w) WHEN 5 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS worst, max(us) AS last_us FROM d GROUP BY n_name""",
    "mean_time": """
SELECT o_orderpriority, round(avg(CASE WHEN b >= a THEN b - a END), 3) AS mean, count(*) FILTER (WHERE b >= a) AS pairs
FROM (SELECT o_orderpriority, floor(epoch_us(o_orderdate) / 1000000) AS a, floor(epoch_us(l_shipdate) / 1000000) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""",
    "technique_frequency": """
SELECT CASE event_type WHEN 'error' THEN 'T1110' WHEN 'purchase' THEN 'T1046' WHEN 'view' THEN 'T1071' WHEN 'signup' THEN 'T1486' ELSE '-' END AS technique,
  CASE event_type WHEN 'error' THEN 'Credential Access' WHEN 'purchase' THEN 'Discovery' WHEN 'view' THEN 'Command and Control' WHEN 'signup' THEN 'Impact' ELSE '-' END AS tactic, count(*) AS n FROM events GROUP BY 1, 2""",
    "store_query": """SELECT event_id, user_id, props FROM events WHERE event_type = 'error' AND contains(lower(props), '"k": 7') ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10""",
    "bm25": """
WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
q AS (SELECT item_id AS query, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2), sz AS (SELECT id, count(*) AS len FROM d GROUP BY 1), c AS (SELECT count(*) AS n, avg(len) AS a FROM sz),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, id AS doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score, count(*) AS m
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN sz USING (id), c GROUP BY 1, 2),
t AS (SELECT query, doc, score, m / (SELECT count(*) FROM q x WHERE x.query = s.query) AS coverage, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM s)
SELECT query, doc, round(score, 6) AS score, round(coverage, 6) AS coverage FROM t WHERE k = 1 AND score >= 1.0 AND coverage >= 0.5""",
    "cited_passages": """
WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
w AS (SELECT item_id, unnest(regexp_extract_all(lower(array_to_string(string_split(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), ' ')[1:20], ' ')), '[a-z0-9]+')) AS term FROM benchmark),
q AS (SELECT item_id AS query, term, count(*) AS qtf FROM w GROUP BY 1, 2),
tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2), sz AS (SELECT id, count(*) AS len FROM d GROUP BY 1), c AS (SELECT count(*) AS n, avg(len) AS a FROM sz),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, id AS doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN sz USING (id), c GROUP BY 1, 2),
b AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM s) WHERE k = 1),
p AS (SELECT query, doc, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM b JOIN documents ON doc_id = doc),
h AS (SELECT query, doc, i, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p, (SELECT count(*) FROM q WHERE q.query = p.query AND list_contains(regexp_extract_all(lower(p.p), '[a-z0-9]+'), q.term)) AS n FROM p WHERE trim(p, ' ' || chr(10) || chr(9) || chr(13)) <> '')
SELECT query, doc, sha256(arg_max(p, n * 100000 - i)) AS passage_sha256 FROM h GROUP BY 1, 2""",
    "precedents": """
WITH t AS (SELECT p_partkey AS id, 'brand' AS dim, p_brand AS value FROM part UNION SELECT p_partkey, 'type', p_type FROM part UNION SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part),
s AS (SELECT a.id, b.id AS other, count(*) AS overlap, count(DISTINCT a.dim) AS dimensions FROM t a JOIN t b ON a.dim = b.dim AND a.value = b.value AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY overlap DESC, dimensions DESC, other) AS INTEGER) AS rank FROM s) SELECT * FROM k WHERE rank <= 10""",
    "set_score": r"""
WITH x AS (SELECT lang, regexp_matches(text, '(?i)\b(idiot|moron|pathetic|worthless|stupid)\b') AS h, toxic = 1 AS w FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (WHERE h AND w) AS tp, count(*) FILTER (WHERE h AND NOT w) AS fp, count(*) FILTER (WHERE w AND NOT h) AS fn FROM x WHERE h OR w GROUP BY lang),
r AS (SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM g)
SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1 FROM r""",
    "scorecard": f"""
WITH {_CITED}
g AS (SELECT rule_id, count(DISTINCT finding) AS findings, count(DISTINCT finding) FILTER (WHERE hit) AS true_findings, count(DISTINCT line) FILTER (WHERE hit) AS lines_hit FROM j GROUP BY ROLLUP (rule_id))
SELECT *, (SELECT count(*) FROM lab) AS labelled, round(true_findings / nullif(findings, 0), 4) AS precision, round(lines_hit / nullif((SELECT count(*) FROM lab), 0), 4) AS recall FROM g""",
    "score_misses": f"""
WITH {_CITED}
x AS (SELECT format, 'miss' AS kind, line AS pos, '<order line ' || line || '>' AS text FROM (SELECT DISTINCT l_linestatus AS format, line FROM l WHERE l_returnflag = 'R') WHERE line NOT IN (SELECT line FROM j WHERE hit)
 UNION ALL SELECT rule_id, 'false positive', finding, 'seen: <order line ' || (finding + 5) || '> and more' FROM (SELECT DISTINCT rule_id, finding FROM c) WHERE finding NOT IN (SELECT finding FROM j WHERE hit)),
y AS (SELECT format, kind, pos, text FROM x UNION ALL SELECT NULL, kind, pos, text FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY format, kind ORDER BY pos, text) AS k FROM y)
SELECT format, kind, count(*) AS n, string_agg(CASE WHEN kind = 'miss' THEN ' ' ELSE '' END || text, '|' ORDER BY k) FILTER (WHERE k <= 3) AS samples FROM k GROUP BY 1, 2""",
    "chunk_findings": """
SELECT l_returnflag, CAST(floor((l_partkey - 1) / 25) AS BIGINT) AS chunk, count(*) AS findings, min(l_partkey) AS first_line, max(l_partkey) AS last_line FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2""",
    "hash_chain": """
WITH o AS (SELECT o_custkey AS ledger, o_orderkey AS seq, o_orderkey % 100 = 3 AND o_orderstatus <> 'X' AS bad FROM orders)
SELECT ledger, count(*) AS entries, count(*) FILTER (WHERE bad) = 0 AS ok, min(seq) FILTER (WHERE bad) AS first_break, CASE WHEN bool_or(bad) THEN 'hash mismatch' END AS reason FROM o GROUP BY ledger""",
    "lifecycle_fold": """
WITH RECURSIVE t AS (SELECT user_id AS incident, event_id AS seq, CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'reopened' WHEN 'signup' THEN 'open' END AS "to",
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS "at" FROM events WHERE event_type <> 'view'),
r AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY seq) AS k FROM t),
g AS (SELECT DISTINCT incident, CAST(0 AS BIGINT) AS k, 'open' AS state, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS rejected, CAST(NULL AS BIGINT) AS ack, CAST(NULL AS BIGINT) AS res FROM r
 UNION ALL SELECT incident, k, CASE WHEN ok THEN "to" ELSE state END, accepted + CAST(ok AS INTEGER), rejected + CAST(NOT ok AS INTEGER),
   CASE WHEN NOT ok THEN ack WHEN "to" = 'acknowledged' THEN "at" WHEN "to" = 'reopened' THEN NULL ELSE ack END, CASE WHEN NOT ok THEN res WHEN "to" = 'resolved' THEN "at" WHEN "to" = 'reopened' THEN NULL ELSE res END
 FROM (SELECT g.incident, r.k, g.state, g.accepted, g.rejected, g.ack, g.res, r."to", r."at", (g.state = 'open' AND r."to" IN ('acknowledged', 'resolved')) OR (g.state = 'acknowledged' AND r."to" IN ('resolved', 'open'))
   OR (g.state = 'resolved' AND r."to" = 'reopened') OR (g.state = 'reopened' AND r."to" IN ('acknowledged', 'resolved')) AS ok FROM g JOIN r ON r.incident = g.incident AND r.k = g.k + 1))
SELECT incident, state, accepted, rejected, ack AS acknowledged_at, res AS resolved_at FROM g WHERE k = (SELECT max(k) FROM r WHERE r.incident = g.incident)""",
    "runbook_eligibility": f"""
WITH f AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS incident, event_type, {_SEV} AS s FROM events),
i AS (SELECT incident, bool_or(event_type = 'error') AS e, bool_or(event_type = 'signup') AS g, min({_RANK.format('s')}) AS r, count(*) >= 5 AS many, count(*) FILTER (WHERE event_type = 'error') >= 2 AS errors FROM f GROUP BY 1),
b AS (SELECT incident, 'rb-user' AS runbook, [CASE WHEN NOT e THEN 'rule' END, CASE WHEN incident % 2 <> 0 THEN 'entity' END, CASE WHEN r > 1 THEN 'severity' END, CASE WHEN NOT errors THEN 'evidence:errors' END] AS m FROM i
 UNION ALL SELECT incident, 'rb-any', [CASE WHEN NOT (e OR g) THEN 'rule' END, CASE WHEN r > 2 THEN 'severity' END, CASE WHEN NOT errors THEN 'evidence:errors' END, CASE WHEN NOT many THEN 'evidence:many' END] FROM i)
SELECT incident, runbook, array_to_string(list_filter(m, lambda x: x IS NOT NULL), ',') AS missing, len(list_filter(m, lambda x: x IS NOT NULL)) = 0 AS eligible FROM b""",
    "redaction_tokens": f"""
WITH x AS (SELECT source, doc_id, regexp_extract_all(text, '{P.IOC_IP}') AS a FROM documents),
y AS (SELECT source, doc_id, unnest(range(len(a))) AS p, unnest(a) AS value FROM x),
f AS (SELECT source, value, min(doc_id * 100000 + p) AS k FROM y GROUP BY 1, 2)
SELECT source AS scope, value, '[IP-' || row_number() OVER (PARTITION BY source ORDER BY k, value) || ']' AS token FROM f""",
    "milestones": """
WITH e AS (SELECT user_id AS source, event_id AS n, epoch_us(ts) AS us, event_type FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY us, n) AS k, count(*) OVER (PARTITION BY source) AS t FROM e WHERE event_type = 'error'),
m AS (SELECT source, n, us, unnest([CASE WHEN k = 1 THEN 'first' END, CASE WHEN k = 5 THEN 'threshold' END, CASE WHEN k = t THEN 'last' END]) AS step FROM f WHERE t >= 5),
l AS (SELECT source, us FROM m WHERE step = 'last'),
s AS (SELECT e.source, 'success' AS step, min(e.n) AS n, arg_min(e.us, e.n) AS us FROM e JOIN l ON l.source = e.source AND e.event_type = 'purchase' AND e.us BETWEEN l.us AND l.us + 86400000000 GROUP BY 1)
SELECT source, step, n, us FROM m WHERE step IS NOT NULL UNION ALL SELECT source, step, n, us FROM s""",
    "event_findings": """
WITH l AS (SELECT l_orderkey AS r, l_linenumber AS n, l_quantity AS q, l_partkey AS p FROM lineitem),
c AS (SELECT r, p, n AS s, unnest([n, n + 1]) AS line FROM l WHERE q >= 40), f AS (SELECT r, line, arg_min(p, s * 100000000 + p) AS p FROM c GROUP BY 1, 2)
SELECT f.p IS NOT NULL AS is_finding, count(*) AS lines, CAST(sum(f.p) AS BIGINT) AS sum_finding FROM l LEFT JOIN f ON f.r = l.r AND f.line = l.n GROUP BY 1""",
    "event_hash_dedupe": "SELECT o_orderpriority, count(*) AS new_rows FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1",
}
