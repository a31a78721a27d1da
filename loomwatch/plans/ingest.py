"""Ingest round trips: lines of a format are built from the events table, parsed back, and compared with the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwatch.functions import patterns as P
from loomwatch.operators import canonical as C
from loomwatch.operators import intel, rules, sigma
from loomwatch.sources import envelopes as E, lines as L, structured as S
from loomwatch.session import table

LEVELS = {"error": "ERROR", "purchase": "WARN", "click": "INFO", "view": "DEBUG", "signup": "CRIT"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("day-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_id").alias("n"), "ts", "user_id", "event_type",
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"), F.concat(F.lit("did "), "event_type").alias("body"),
        F.format_string("%d.%d.%d.%d", F.lit(10), F.pmod("user_id", F.lit(200)), F.pmod("event_id", F.lit(250)), F.lit(7)).alias("ip"),
        E.lookup(LEVELS, F.col("event_type")).alias("want_level"),
    )


def _lines(spark: SparkSession, sf_dir: str, raw: Column) -> DataFrame:
    return _events(spark, sf_dir).select("run_id", "n", raw.alias("raw"))


def _summary(records: DataFrame) -> DataFrame:
    """Counts and checks of the parsed records per run and level."""
    return records.groupBy("run_id", "level").agg(
        F.count("*").alias("lines"), F.count_distinct("host").alias("hosts"), F.min("n").alias("first_n"), F.max("n").alias("last_n"),
        F.sum(F.unix_seconds("ts")).alias("sum_ts"),
    )


_ORACLE = """
SELECT 'day-' || strftime(ts, '%Y-%m-%d') AS run_id, {level} AS level, count(*) AS lines, {hosts} AS hosts,
       min(event_id) AS first_n, max(event_id) AS last_n, CAST(sum({ts}) AS BIGINT) AS sum_ts
FROM events GROUP BY 1, 2"""
_CASE = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'CRIT' END"
_SEC = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def ingest_canonical(spark, sf_dir):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), "want_level", F.lit("  "), "host", F.lit(" "), "body")
    return _summary(E.canonical(_lines(spark, sf_dir, raw)))


def ingest_rfc5424(spark, sf_dir):
    pri = E.lookup({"error": "27", "purchase": "28", "click": "30", "view": "31", "signup": "26"}, F.col("event_type"))
    raw = F.concat(F.lit("<"), pri, F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), "host", F.lit(' app 77 ID1 [x@1 k="v"] '), "body")
    return _summary(E.rfc5424(_lines(spark, sf_dir, raw)))


def ingest_jsonlog(spark, sf_dir):
    raw = F.to_json(F.struct(F.unix_seconds("ts").cast("string").alias("Time"), F.lower("want_level").alias("severity"), F.col("body").alias("msg"), F.col("host").alias("HostName")))
    return _summary(E.jsonlog(_lines(spark, sf_dir, raw)))


def ingest_rfc3164(spark, sf_dir):
    """The year is left out of the line and inferred back; the level comes from the words."""
    raw = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" svc[12]: "), "event_type")
    e = _events(spark, sf_dir)
    year = e.agg(F.min(F.year("ts")).alias("_base"))
    lines = e.select(F.lit("all").alias("run_id"), "n", raw.alias("raw")).crossJoin(F.broadcast(year))
    parsed = E.rfc3164(lines, F.col("_base"))
    return _summary(parsed.withColumn("run_id", F.concat(F.lit("day-"), F.date_format("ts", "yyyy-MM-dd"))))


def ingest_logcat(spark, sf_dir):
    letter = E.lookup({"error": "E", "purchase": "W", "click": "I", "view": "V", "signup": "F"}, F.col("event_type"))
    raw = F.concat(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), F.lit("  1702  2395 "), letter, F.lit(" Tag: "), "body")
    e = _events(spark, sf_dir)
    year = e.agg(F.min(F.year("ts")).alias("_base"))
    return _summary(E.logcat(e.select("run_id", "n", raw.alias("raw")).crossJoin(F.broadcast(year)), F.col("_base")))


def ingest_log4j(spark, sf_dir):
    """Five layouts in turn, by line number."""
    ms = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    k = F.pmod("n", F.lit(5))
    level = E.lookup({"error": "ERROR", "purchase": "WARN", "click": "INFO", "view": "DEBUG", "signup": "FATAL"}, F.col("event_type"))
    raw = (
        F.when(k == 0, F.concat(ms, F.lit(" - "), level, F.lit("  "), "body"))
        .when(k == 1, F.concat(ms, F.lit(" "), level, F.lit(" [main] "), "body"))
        .when(k == 2, F.concat(F.date_format("ts", "yy/MM/dd HH:mm:ss"), F.lit(" "), level, F.lit(" "), "body"))
        .when(k == 3, F.concat(F.date_format("ts", "yyMMdd HHmmss"), F.lit(" 148 "), level, F.lit(" "), "body"))
        .otherwise(F.concat(F.lit("nova.log "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" 25746 "), level, F.lit(" "), "body"))
    )
    return _summary(E.log4j(_lines(spark, sf_dir, raw)))


def ingest_bgl(spark, sf_dir):
    level = E.lookup({"error": "ERROR", "purchase": "WARN", "click": "INFO", "view": "DEBUG", "signup": "FATAL"}, F.col("event_type"))
    raw = F.concat(
        F.lit("- 1117838570 "), F.date_format("ts", "yyyy.MM.dd"), F.lit(" "), "host", F.lit(" "), F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS"),
        F.lit(" "), "host", F.lit(" RAS KERNEL "), level, F.lit(" "), "body",
    )
    return _summary(E.bgl(_lines(spark, sf_dir, raw)))


def ingest_mixed(spark, sf_dir):
    """Runs of different formats are sniffed and each parsed by its own parser: format, coverage and first example."""
    e = _events(spark, sf_dir)
    k = F.pmod(F.dayofmonth("ts"), F.lit(4))
    raw = (
        F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" INFO  "), "host", F.lit(" "), "body"))
        .when(k == 1, F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" svc[12]: "), "body"))
        .when(k == 2, F.to_json(F.struct(F.col("body").alias("msg"))))
        .otherwise(F.concat(F.lit("?? "), "body"))
    )
    # every hundredth line is not parsable
    raw = F.when(F.pmod("n", F.lit(100)) == 99, F.lit("***")).otherwise(raw)
    lines = e.select("run_id", "n", raw.alias("raw"))
    formats = L.sniff(lines)
    parsed = E.ingest(lines, formats)
    native = parsed.filter("format <> 'generic'")
    cov = L.coverage(lines, native)
    return cov.join(formats, "run_id").select("run_id", "format", "total", "parsed", "unparsed", F.size(F.coalesce("examples", F.array().cast("array<string>"))).alias("examples"), "verdict")


def level_synthesis(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", E.level_from_text(F.coalesce("text", F.lit(""))).alias("level"))
    return d


def auth_vocabulary(spark, sf_dir):
    """Four vendors' wording of one login, brought into one vocabulary and counted by kind and source."""
    e = _events(spark, sf_dir).withColumn("user", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    k = F.pmod("n", F.lit(5))
    msg = (
        F.when(k == 0, F.concat(F.lit("Failed password for invalid user "), "user", F.lit(" from "), "ip", F.lit(" port 22")))
        .when(k == 1, F.concat(F.lit("Invalid user "), "user", F.lit(" from "), "ip"))
        .when(k == 2, F.concat(F.lit("authentication failure; logname= rhost="), "ip", F.lit("  user="), "user"))
        .when(k == 3, F.concat(F.lit("Accepted publickey for "), "user", F.lit(" from "), "ip"))
        .otherwise(F.lit("session opened"))
    )
    r = e.select("run_id", "n", msg.alias("raw"), msg.alias("msg"))
    c = C.canonicalise(r)
    same = (F.coalesce("original_msg", "msg") == F.col("raw")).cast("int")
    return c.groupBy(F.coalesce("kind", F.lit("untouched")).alias("kind"), F.coalesce("auth_source", F.lit("-")).alias("source")).agg(
        F.count("*").alias("n"), F.count_distinct("auth_ip").alias("ips"), F.count_distinct("auth_user").alias("users"), F.min(same).alias("raw_kept")
    )


def auth_companion_dedupe(spark, sf_dir):
    """Companion rows (views) go where the same user and hour has an anchor (click); null keys match null keys."""
    e = table(spark, sf_dir, "events")
    hour = F.when(F.pmod("event_id", F.lit(50)) != 0, F.date_trunc("hour", "ts"))
    src = E.lookup({"click": "failed_password", "view": "invalid_user"}, F.col("event_type"))
    r = e.select(F.lit("r").alias("run_id"), F.col("event_id").alias("n"), F.col("user_id").alias("auth_ip"), hour.alias("pid"), src.alias("auth_source"), "event_type")
    return C.drop_companions(r).groupBy("event_type").agg(F.count("*").alias("kept"))


SIGMA = [
    {"id": "s-license", "level": "low", "detection": {"sel": {"text|contains": ["License", "licensed"]}, "condition": "sel"}},
    {"id": "s-insult", "level": "high", "detection": {"a": {"text|contains": ["idiot", "moron", "pathetic"]}, "b": {"lang": "en"}, "condition": "a and b"}},
    {"id": "s-version", "level": "medium", "detection": {"sel1": {"text|contains": ["version 3"]}, "sel2": {"text|re": "gnu .* license"}, "f": {"source|startswith": "src1"}, "condition": "sel* and not f"}},
]


def sigma_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.select(F.lit("docs").alias("run_id"), F.col("doc_id").alias("n"), F.col("text").alias("raw"), F.col("source").alias("host"), "lang")
    h = sigma.hits(r, SIGMA, {"text": F.col("raw"), "lang": F.col("lang"), "source": F.col("host")})
    f = sigma.findings(h)
    return f.select("rule_id", "rule_level", "hits", "first_n", F.array_join("hosts", ",").alias("hosts"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


THREAT_LINES = [
    "files encrypted on share", "confirmed breach, port scan", "beaconing to relay", "Trojan found", "scheduled task created", "sudoers modified", "psexec run",
    "nmap scan", "password spray", "evil twin near", "data exfiltration", "ordinary line", "another line",
]
DEVICE_LINES = ["fortigate up", "bgp session", "spanning-tree change", "aruba joined", "iscsi login", "splunk restart", "forcepoint hit", "sshd ready", "eventid 7", "toaster on"]
GENERIC_LINES = [
    "FATAL stop", "oom-killer invoked", "no space left on device", "failed to start unit", "segfault at 0", "connection reset by peer", "certificate has expired",
    "login failed", "permission denied", "checksum mismatch", "dropped packet", "HTTP/1.1 503", "database deadlock", "all is well",
]


def _in_turn(lines: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, lines)), (F.pmod(k, F.lit(len(lines))) + 1).cast("int"))


def threat_patterns(spark, sf_dir):
    """Documents, and lines of every kind of threat; the first pattern that matches names it."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("raw"))
    e = _events(spark, sf_dir).select(F.lit("event").alias("kind"), "n", _in_turn(THREAT_LINES, F.col("n")).alias("raw"))
    d = d.unionByName(e).select("kind", "n", rules.once(rules.first_threat(F.col("raw"))).alias("t"))
    return d.filter("t is not null").select("kind", "n", F.col("t.severity").alias("severity"), F.col("t.type").alias("type"))


def ioc_observed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.array_join(rules.indicators(F.col("text"), P.IOC_IP), ",").alias("ips"), F.size(rules.indicators(F.col("text"), P.IOC_HASH)).alias("hashes"), F.col("text").rlike(P.IOC_CONTEXT).alias("context"))
    return d.filter("ips <> '' or hashes > 0")


def ioc_match(spark, sf_dir):
    """Addresses in documents against addresses in web pages."""
    docs = intel.observed(table(spark, sf_dir, "documents"), "text", ["doc_id"]).filter("ioc_type = 'ipv4'")
    feed = intel.observed(table(spark, sf_dir, "pages"), "html", ["page_id"]).filter("ioc_type = 'ipv4'")
    feed = feed.groupBy("ioc_type", "value").agg(F.count_distinct("page_id").alias("feeds"))
    m = intel.match(docs, feed)
    return m.groupBy("value").agg(F.count_distinct("doc_id").alias("docs"), F.max("feeds").alias("feeds"))


def device_types(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("t"))
    e = _events(spark, sf_dir).select(_in_turn(DEVICE_LINES, F.col("n")).alias("t"))
    return d.unionByName(e).groupBy(rules.device_type(F.col("t")).alias("device")).agg(F.count("*").alias("n"))


def generic_rules(spark, sf_dir):
    """The thirteen generic rules over lines of every kind, by day."""
    r = rules.counted_rules(_events(spark, sf_dir).select("run_id", "n", _in_turn(GENERIC_LINES, F.col("n")).alias("raw")), P.GENERIC_RULES)
    return r.select("run_id", "rule", "hits", "first_n", "last_n", "severity", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def html_rows(spark, sf_dir):
    """Text rows of web pages: closing row, paragraph, division and item tags end a row; other tags go."""
    rows = S.html_rows(table(spark, sf_dir, "pages"))
    return rows.groupBy("page_id").agg(F.count("*").alias("rows"), F.sum(F.length("row")).alias("chars"), F.min_by("row", "k").alias("first_row"))


def address_classes(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.format_string("%d.%d.1.1", F.element_at(F.array(*map(F.lit, (10, 172, 192, 127, 169, 8))), (F.pmod("n", F.lit(6)) + 1).cast("int")), F.pmod("user_id", F.lit(256))).alias("ip"))
    return e.groupBy(intel.address_class(F.col("ip")).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    ingest_canonical, ingest_rfc5424, ingest_jsonlog, ingest_rfc3164, ingest_logcat, ingest_log4j, ingest_bgl, ingest_mixed, level_synthesis,
    auth_vocabulary, auth_companion_dedupe, sigma_hits, threat_patterns, ioc_observed, ioc_match, device_types, generic_rules, html_rows, address_classes,
)}

_HOSTS = "count(DISTINCT user_id)"


def _rx(pattern: str) -> str:
    return "'(?i)" + pattern.replace("(?i)", "").replace("'", "''") + "'"


def _first(cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {_rx(p)}) THEN '{v}'" for p, v in cases) + f" ELSE {default} END"


def _list(lines: list[str]) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + f"])[event_id % {len(lines)} + 1]"


_T = "(SELECT *, coalesce(text, '') AS t FROM documents)"
ORACLES = {
    "ingest_canonical": _ORACLE.format(level=_CASE, hosts=_HOSTS, ts=_SEC),
    "ingest_rfc5424": _ORACLE.format(level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END", hosts=_HOSTS, ts=_SEC),
    "ingest_jsonlog": _ORACLE.format(level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END", hosts=_HOSTS, ts=_SEC),
    "ingest_rfc3164": _ORACLE.format(level="CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END", hosts=_HOSTS, ts=_SEC),
    "ingest_logcat": _ORACLE.format(level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'CRIT' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END", hosts="CAST(0 AS BIGINT)", ts=_SEC),
    "ingest_log4j": _ORACLE.format(level=_CASE, hosts="CAST(0 AS BIGINT)", ts=_SEC),
    "ingest_bgl": _ORACLE.format(level=_CASE, hosts=_HOSTS, ts=_SEC),
    "ingest_mixed": """
WITH e AS (SELECT 'day-' || strftime(ts, '%Y-%m-%d') AS run_id, day(ts) % 4 AS k, event_id % 100 = 99 AS bad FROM events),
g AS (SELECT run_id, k, count(*) AS total, count(*) FILTER (NOT bad AND k < 3) AS parsed FROM e GROUP BY run_id, k)
SELECT run_id, CASE k WHEN 0 THEN 'canonical' WHEN 1 THEN 'rfc3164' WHEN 2 THEN 'jsonlog' ELSE 'unknown' END AS format, total, parsed,
       total - parsed AS unparsed, CAST(least(5, total - parsed) AS INTEGER) AS examples,
       CASE WHEN parsed = 0 THEN 'unrecognised' ELSE 'parsed' END AS verdict FROM g""",
    "level_synthesis": f"SELECT doc_id, {_first(P.LEVEL_HINTS, chr(39) + 'INFO' + chr(39))} AS level FROM {_T}",
    "auth_vocabulary": """
WITH e AS (SELECT event_id % 5 AS k, user_id, '10.' || (user_id % 200) || '.' || (event_id % 250) || '.7' AS ip FROM events)
SELECT CASE WHEN k < 3 THEN 'auth_fail' WHEN k = 3 THEN 'auth_ok' ELSE 'untouched' END AS kind,
       CASE k WHEN 0 THEN 'failed_password' WHEN 1 THEN 'invalid_user' WHEN 2 THEN 'pam_failure' WHEN 3 THEN 'accepted_password' ELSE '-' END AS source,
       count(*) AS n, CASE WHEN k < 4 THEN count(DISTINCT ip) ELSE 0 END AS ips, CASE WHEN k < 4 THEN count(DISTINCT user_id) ELSE 0 END AS users, 1 AS raw_kept
FROM e GROUP BY k""",
    "auth_companion_dedupe": """
WITH e AS (SELECT *, CASE WHEN event_id % 50 <> 0 THEN date_trunc('hour', ts) END AS h FROM events)
SELECT event_type, count(*) AS kept FROM e WHERE NOT (event_type = 'view' AND EXISTS (
  SELECT 1 FROM e a WHERE a.event_type = 'click' AND a.user_id = e.user_id AND a.h IS NOT DISTINCT FROM e.h)) GROUP BY event_type""",
    "sigma_hits": f"""
WITH d AS (SELECT *, lower(t) AS l FROM {_T}),
h AS (SELECT 's-license' AS rule_id, 'low' AS rule_level, doc_id, source FROM d WHERE contains(l, 'license') OR contains(l, 'licensed')
 UNION ALL SELECT 's-insult', 'high', doc_id, source FROM d WHERE (contains(l, 'idiot') OR contains(l, 'moron') OR contains(l, 'pathetic')) AND contains(lower(lang), 'en')
 UNION ALL SELECT 's-version', 'medium', doc_id, source FROM d WHERE (contains(l, 'version 3') OR regexp_matches(t, '(?i)gnu .* license')) AND NOT starts_with(lower(source), 'src1')),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id) AS r FROM h)
SELECT rule_id, rule_level, count(*) AS hits, min(doc_id) AS first_n, string_agg(DISTINCT source, ',' ORDER BY source) AS hosts,
       string_agg(CASE WHEN r <= 12 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS lines FROM k GROUP BY rule_id, rule_level""",
    "threat_patterns": "WITH x AS (SELECT kind, n, " + _first([(p, f"{s}|{k}") for s, k, p in P.THREATS], "NULL")
    + f" AS v FROM (SELECT 'document' AS kind, doc_id AS n, t FROM {_T} UNION ALL SELECT 'event', event_id, {_list(THREAT_LINES)} FROM events)) SELECT kind, n, split_part(v, '|', 1) AS severity, split_part(v, '|', 2) AS type FROM x WHERE v IS NOT NULL",
    "ioc_observed": f"""
WITH x AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '{P.IOC_IP}'))) AS i,
  len(list_distinct(regexp_extract_all(t, {_rx(P.IOC_HASH)}))) AS h, regexp_matches(t, {_rx(P.IOC_CONTEXT)}) AS context FROM {_T})
SELECT doc_id, array_to_string(i, ',') AS ips, CAST(h AS INTEGER) AS hashes, context FROM x WHERE len(i) > 0 OR h > 0""",
    "ioc_match": f"""
WITH x AS (SELECT DISTINCT doc_id, source, lang, unnest(regexp_extract_all(t, '{P.IOC_IP}')) AS value FROM {_T}),
p AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(coalesce(html, ''), '{P.IOC_IP}')) AS value FROM pages),
f AS (SELECT value, count(*) AS feeds FROM p GROUP BY value)
SELECT value, count(DISTINCT doc_id) AS docs, max(feeds) AS feeds FROM x JOIN f USING (value) GROUP BY value""",
    "device_types": "SELECT " + _first([(p, k) for k, p in P.DEVICES.items()], "'unknown'")
    # a word boundary beside an accented letter: RE2 sees one, Spark and the rules do not
    + r" AS device, count(*) AS n FROM (SELECT regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS t FROM documents UNION ALL SELECT " + _list(DEVICE_LINES) + " FROM events) GROUP BY 1",
    "generic_rules": f"""
WITH h AS (SELECT 'day-' || strftime(ts, '%Y-%m-%d') AS run_id, event_id AS n, {_list([r for r, _, _ in P.GENERIC_RULES] + [""])} AS rule, {_list([b for _, b, _ in P.GENERIC_RULES] + [""])} AS base FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, rule ORDER BY n) AS r FROM h WHERE rule <> '')
SELECT run_id, rule, count(*) AS hits, min(n) AS first_n, max(n) AS last_n,
  CASE WHEN count(*) >= 10 THEN CASE base WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE base END AS severity,
  string_agg(CASE WHEN r <= 8 THEN CAST(n AS VARCHAR) END, ',' ORDER BY n) AS lines FROM k GROUP BY run_id, rule, base""",
    "html_rows": r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?i)</(tr|p|div|li)\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS a FROM pages),
r AS (SELECT page_id, unnest(range(len(a))) AS k, unnest(a) AS x FROM p),
t AS (SELECT page_id, k, trim(regexp_replace(x, '[ \t\r\n\f]+', ' ', 'g')) AS "row" FROM r)
SELECT page_id, count(*) AS "rows", CAST(sum(length("row")) AS BIGINT) AS chars, arg_min("row", k) AS first_row FROM t WHERE "row" <> '' GROUP BY page_id""",
    "address_classes": """
WITH e AS (SELECT CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 127 WHEN 4 THEN 169 ELSE 8 END AS a, user_id % 256 AS b FROM events)
SELECT CASE WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link-local' WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private'
  ELSE 'public' END AS kind, count(*) AS n FROM e GROUP BY 1""",
}
