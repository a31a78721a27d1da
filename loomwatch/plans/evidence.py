"""Ranges of lines, timelines and incident histories on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.operators import ledger, lifecycle, packs, ranges, triage, views as V
from loomwatch.session import table
from loomwatch.sources.envelopes import lookup


def range_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of very different lengths that overlap, over events as the records of two runs."""
    run = lambda c: F.when(c, "errors").otherwise("rest")
    p = table(spark, sf_dir, "events").select(run(F.col("event_type") == "error").alias("run_id"), F.col("event_id").alias("n"))
    wide = F.when(F.pmod("o_orderkey", F.lit(50)) == 0, F.col("o_custkey") * 7).when(F.pmod("o_orderkey", F.lit(3)) == 0, 0).otherwise(F.pmod("o_custkey", F.lit(13)))
    r = table(spark, sf_dir, "orders").select(run(F.col("o_orderstatus") == "F").alias("run_id"), F.col("o_orderkey").alias("finding"), F.pmod(F.col("o_orderkey") * 37, F.lit(12_000)).alias("lo"), wide.alias("w"))
    r = r.withColumn("hi", F.col("lo") + F.col("w")).drop("w")
    d = ranges.range_totals(p, r, ["run_id"], "n", "lo", "hi")
    return d.groupBy("run_id", "finding").agg(F.sum("records").alias("records"), F.min("first").alias("first_n"), F.max("last").alias("last_n"))


def timeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of bursts (five lines from an error on), of break-in sources and of single lines; a user's events are a run."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "signup", F.format_string("reverse mapping from 10.0.0.%d failed - POSSIBLE BREAK-IN ATTEMPT!", F.pmod("event_id", F.lit(3)))).otherwise(F.concat(F.lit("did "), "event_type"))
    rec = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("n"), F.when(F.pmod("event_id", F.lit(11)) != 0, F.col("ts")).alias("ts"), text.alias("raw"), "event_type")
    none = F.lit(None)
    cols = {"run_id": "long", "finding": "string", "type": "string", "evidence": "string", "lo": "long", "hi": "long", "ip": "string", "count": "long", "summary": "string"}
    make = lambda d, **kw: d.select(*(kw.get(c, none).cast(t).alias(c) for c, t in cols.items()))
    errors = rec.filter("event_type = 'error'").groupBy("run_id").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("k"))
    runs = rec.select("run_id").distinct()
    f = make(errors, run_id=F.col("run_id"), finding=F.lit("burst"), type=F.lit("error_rate_spike"), lo=F.col("a"), hi=F.col("b"), count=F.col("k"))
    for k in range(3):
        f = f.unionByName(make(runs, run_id=F.col("run_id"), finding=F.lit(f"break-in {k}"), type=F.lit("possible_break_in"), ip=F.lit(f"10.0.0.{k}")))
    f = f.unionByName(make(runs, run_id=F.col("run_id"), finding=F.lit("line"), type=F.lit("disk_pressure"), evidence=F.lit("did purchase"), summary=F.lit("A purchase")))
    d = V.timelines(f, rec)
    return d.select("run_id", "finding", "step", "n", F.unix_micros("ts").alias("us"), "label")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as an analyst's moves on one incident; some closings carry a disposition, some a bad one."""
    e = table(spark, sf_dir, "events")
    to = lookup({"click": "Acknowledged", "purchase": "closed", "error": "investigating", "signup": "bogus", "view": "new"}, F.col("event_type"))
    closing, k = F.col("event_type") == "purchase", F.pmod("event_id", F.lit(4))
    said = F.when(closing & (k == 0), "FP").when(closing & (k == 1), " confirmed ").when(closing & (k == 3) & (F.pmod("event_id", F.lit(8)) == 3), "weird").when((F.col("event_type") == "click") & (F.pmod("event_id", F.lit(5)) == 0), "fp")
    why = F.when(closing & (F.pmod("event_id", F.lit(3)) == 0), "because")
    return e.select(F.col("user_id").alias("incident"), F.col("event_id").alias("seq"), to.alias("to"), F.unix_seconds("ts").alias("at"), said.alias("disposition"), why.alias("reason"))


def incident_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current(_moves(spark, sf_dir), 500)


def incident_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.history(_moves(spark, sf_dir), 500)


def rejected_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.rejects(_moves(spark, sf_dir), 500)


def pack_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand rules over every document in one scan: rule k asks for the number k on its own, outside English."""
    rules = [{"id": f"n-{k}", "level": "low", "detection": {"sel": {"text": [str(k)]}, "en": {"lang": "en"}, "condition": "sel and not en"}} for k in range(2000)]
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    h = packs.hits(d, rules, {"text": F.col("text"), "lang": F.col("lang")})
    return h.groupBy("rule_id", "rule_level").agg(F.count("*").alias("hits"), F.min("doc_id").alias("first_doc"))


def canonical_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of nested entries whose keys come in another order at every depth."""
    o = table(spark, sf_dir, "orders")
    proof = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("z"), F.lit("é").alias("b")).alias("asset"), F.array(F.struct(F.lit(1).alias("k"), F.lit(True).alias("a"))).alias("rules"))
    text = F.to_json(F.struct(F.col("o_orderkey").alias("seq"), proof.alias("proof")))
    d = o.select(F.col("o_orderkey").alias("seq"), text.alias("entry"))
    return d.select("seq", F.sha2(ledger.canonical_text(F.col("entry")), 256).alias("entry_hash"))


def fold_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst, best and mean scores over five folds of labelled documents, where the opinion is that insults stand in the text."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    hit = F.when(F.col("text").rlike(r"(?i)\b(idiot|moron|pathetic|worthless|stupid)\b"), 1).otherwise(0)
    return triage.spread(triage.fold_scores(d.select(F.pmod("doc_id", F.lit(5)).alias("fold"), F.col("toxic").alias("label"), hit.alias("opinion"))))


QUERIES = {f.__name__: f for f in (range_totals, timeline_steps, incident_current, incident_history, rejected_moves, pack_hits, canonical_entries, fold_spread)}

_REC = """r AS (SELECT user_id AS run_id, event_id AS n, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) END AS us, event_type,
  CASE event_type WHEN 'signup' THEN '10.0.0.' || (event_id % 3) END AS ip FROM events)"""
_M = """e AS (SELECT user_id AS incident, event_id AS seq, CASE event_type WHEN 'click' THEN 'triaged' WHEN 'purchase' THEN 'closed' WHEN 'error' THEN 'investigating' WHEN 'signup' THEN 'bogus' ELSE 'new' END AS t,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS tm, event_type = 'purchase' AS c, event_id AS i, event_type AS y FROM events),
d AS (SELECT *, CASE WHEN c AND i % 4 = 0 THEN 'false-positive' WHEN c AND i % 4 = 1 THEN 'confirmed' WHEN c AND i % 8 = 3 THEN 'weird' WHEN y = 'click' AND i % 5 = 0 THEN 'false-positive' END AS disp, CASE WHEN c AND i % 3 = 0 THEN 'because' END AS reason FROM e),
b AS (SELECT *, CASE WHEN t = 'bogus' THEN 'unknown state' WHEN disp = 'weird' THEN 'unknown disposition' WHEN disp IS NOT NULL AND NOT c THEN 'disposition without closing' WHEN reason IS NOT NULL AND disp IS NULL THEN 'reason without disposition' END AS bad FROM d),
v AS (SELECT *, coalesce(lag(t) OVER w, 'new') AS f, t <> 'closed' AS live, count(*) FILTER (WHERE t <> 'closed') OVER (PARTITION BY incident ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM b WHERE bad IS NULL WINDOW w AS (PARTITION BY incident ORDER BY seq)),
s AS (SELECT incident, g, arg_max(disp, seq) AS disp, arg_max(coalesce(reason, ''), seq) AS reason, arg_max(tm, seq) AS tm, count(*) AS n FROM v WHERE disp IS NOT NULL GROUP BY 1, 2)"""
ORACLES = {
    "pack_hits": r"""
WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS k FROM documents WHERE NOT contains(lower(coalesce(lang, '')), 'en'))
SELECT 'n-' || k AS rule_id, 'low' AS rule_level, count(*) AS hits, min(doc_id) AS first_doc FROM x WHERE k IN (SELECT CAST(r AS VARCHAR) FROM range(2000) t(r)) GROUP BY k""",
    "canonical_entries": """
SELECT o_orderkey AS seq, sha256('{"proof":{"asset":{"b":"é","z":' || o_custkey || '},"rules":[{"a":true,"k":1}],"status":"' || o_orderstatus || '"},"seq":' || o_orderkey || '}') AS entry_hash FROM orders""",
    "fold_spread": r"""
WITH x AS (SELECT doc_id % 5 AS fold, toxic AS a, CAST(regexp_matches(text, '(?i)\b(idiot|moron|pathetic|worthless|stupid)\b') AS INTEGER) AS b FROM documents JOIN labels USING (doc_id)),
c AS (SELECT fold, k, count(*) FILTER (WHERE a = k AND b = k) AS tp, count(*) FILTER (WHERE a <> k AND b = k) AS fp, count(*) FILTER (WHERE a = k AND b <> k) AS fn FROM x, (VALUES (0), (1)) v(k) GROUP BY 1, 2),
s AS (SELECT fold, round(avg(2 * tp / (2 * tp + fp + fn)), 4) AS macro_f1 FROM c WHERE tp + fp + fn > 0 GROUP BY 1),
y AS (SELECT fold, round(sum(CASE WHEN a = b THEN 1 ELSE 0 END) / count(*), 4) AS accuracy FROM x GROUP BY 1),
m AS (SELECT 'accuracy' AS metric, accuracy AS v FROM y UNION ALL SELECT 'macro_f1', macro_f1 FROM s)
SELECT metric, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean FROM m GROUP BY 1""",
    "range_totals": """
WITH p AS (SELECT CASE WHEN event_type = 'error' THEN 'errors' ELSE 'rest' END AS run_id, event_id AS n FROM events),
r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'errors' ELSE 'rest' END AS run_id, o_orderkey AS finding, (o_orderkey * 37) % 12000 AS lo, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey * 7 WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 13 END AS w FROM orders)
SELECT r.run_id, finding, count(*) AS records, min(n) AS first_n, max(n) AS last_n FROM r JOIN p ON p.run_id = r.run_id AND n BETWEEN lo AND lo + w GROUP BY 1, 2""",
    "timeline_steps": f"""
WITH {_REC},
b AS (SELECT run_id, min(n) AS a, max(n) AS z, count(*) AS k FROM r WHERE event_type = 'error' GROUP BY 1),
i AS (SELECT run_id, ip, n, us, row_number() OVER (PARTITION BY run_id, ip ORDER BY us NULLS LAST, n) AS k, count(*) OVER (PARTITION BY run_id, ip) AS c FROM r WHERE ip IS NOT NULL)
SELECT b.run_id, 'burst' AS finding, 1 AS step, n, us, 'Burst window opens' AS label FROM b JOIN r ON r.run_id = b.run_id AND n = a
UNION ALL SELECT b.run_id, 'burst', 2, n, us, 'Event ' || k || ' closes the 60s window' FROM b JOIN r ON r.run_id = b.run_id AND n = z WHERE z <> a
UNION ALL SELECT run_id, 'break-in ' || right(ip, 1), 1, n, us, 'First reverse-DNS mismatch flagged from ' || ip FROM i WHERE k = 1
UNION ALL SELECT run_id, 'break-in ' || right(ip, 1), 2, n, us, 'Mismatch ' || c || ' from the same source' FROM i WHERE k = c AND c > 1
UNION ALL SELECT run_id, 'line', 1, min(n), arg_min(us, n), 'A purchase' FROM (SELECT run_id, n, us, rank() OVER (PARTITION BY run_id ORDER BY n) AS k FROM r WHERE event_type = 'purchase') WHERE k = 1 GROUP BY run_id""",
    "incident_current": f"""
WITH {_M},
l AS (SELECT incident, max(CASE WHEN live THEN seq END) AS nl, count(*) FILTER (WHERE live) AS lives FROM v GROUP BY 1),
x AS (SELECT v.incident, arg_max(t, seq) AS state, arg_min(CASE WHEN t <> 'new' THEN tm END, CASE WHEN t <> 'new' THEN seq END) AS acknowledged_at, min(CASE WHEN NOT live AND seq > coalesce(nl, -1) THEN seq END) AS rs FROM v JOIN l USING (incident) GROUP BY 1)
SELECT i.incident, coalesce(state, 'new') AS state, acknowledged_at, (SELECT tm FROM v WHERE v.incident = i.incident AND v.seq = rs) AS resolved_at, s.disp AS disposition, nullif(s.reason, '') AS disposition_reason, s.tm AS disposition_at,
  coalesce((SELECT sum(n) FROM s y WHERE y.incident = i.incident), 0)::BIGINT AS "set", (SELECT count(*) FROM s y WHERE y.incident = i.incident AND y.g < l.lives) AS cleared, (SELECT count(*) FROM b WHERE b.incident = i.incident AND bad IS NOT NULL) AS rejected
FROM (SELECT DISTINCT incident FROM e) i LEFT JOIN x USING (incident) LEFT JOIN l USING (incident) LEFT JOIN s ON s.incident = i.incident AND s.g = l.lives""",
    "incident_history": f"""
WITH {_M}
SELECT incident, seq, 'set' AS action, disp AS disposition, reason, tm AS "at", f AS from_state, t AS to_state FROM v WHERE disp IS NOT NULL
UNION ALL SELECT v.incident, v.seq, 'cleared', s.disp, NULL, v.tm, v.f, v.t FROM v JOIN s ON s.incident = v.incident AND s.g = v.g WHERE live""",
    "rejected_moves": f"""
WITH {_M}
SELECT b.incident, b.seq, b.t AS "to", coalesce((SELECT arg_max(v.t, v.seq) FROM v WHERE v.incident = b.incident AND v.seq < b.seq), 'new') AS from_state, bad AS rejected_for FROM b WHERE bad IS NOT NULL""",
}
