"""Store views, lists and further line formats on the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.operators import enrich, incidents as I, intel, investigate, rules, score, views as V
from loomwatch.plans.ingest import _CASE, _HOSTS, _ORACLE, _SEC, _events, _lines, _summary
from loomwatch.plans.incident import _SEV, SEV
from loomwatch.session import table
from loomwatch.sources import envelopes as E, sinks, structured as S
from loomwatch.sources.envelopes import lookup

_DAY = "'day-' || strftime(ts, '%Y-%m-%d')"


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("severity", lookup(SEV, F.col("event_type")))


def user_rollup(spark, sf_dir):
    """Logins in three wordings name users; findings are the errors."""
    e = _e(spark, sf_dir)
    name = F.concat(F.lit("u"), F.pmod("user_id", F.lit(97)).cast("string"))
    k = F.pmod("n", F.lit(3))
    msg = F.when(k == 0, F.concat(F.lit("auth failed for user '"), name, F.lit("' from x"))).when(k == 1, F.concat(F.lit("session opened user="), name)).otherwise("idle")
    title = F.concat(F.lit("5 failed logins user="), name, F.lit(" user="), name)
    d = V.user_rollup(e.select(msg.alias("msg")), e.filter("event_type = 'error'").select(title.alias("title"), "severity"))
    return V.by_risk(d)


def store_figures(spark, sf_dir):
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    vulns = o.select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("fixed").alias("status"))
    iocs = s.select(F.when(F.col("s_acctbal") < 0, "Malicious").when(F.col("s_acctbal") < 1000, "suspicious").otherwise("clean").alias("verdict"))
    return V.store_figures(_e(spark, sf_dir), table(spark, sf_dir, "customer"), vulns, iocs)


def source_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "source_type")
    return V.source_status(e, ["click", "error", "syslog", "view"])


def store_defaults(spark, sf_dir):
    """Customers become assets, order lines vulnerabilities, suppliers indicators; what is missing takes the store's defaults."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "crown-jewel").alias("criticality"))
    v = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "HIGH").alias("severity"), F.when(F.col("l_linestatus") == "F", "fixed").alias("status"), F.when(F.col("l_discount") > 0.05, 5.0).alias("cvss"))
    i = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") < 0, "malicious").alias("verdict"))
    kind = lambda d, k, *cols: d.groupBy(F.lit(k).alias("kind"), F.concat_ws("|", *cols).alias("value")).agg(F.count("*").alias("n"))
    a = kind(V.with_defaults(c, V.ASSET), "asset", "criticality", "owner")
    b = kind(V.with_defaults(v, V.VULNERABILITY), "vulnerability", "severity", "status", F.col("cvss").cast("int").cast("string"))
    return a.unionByName(b).unionByName(kind(V.with_defaults(i, V.IOC), "ioc", "verdict", F.col("score").cast("int").cast("string")))


def _incidents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("incident_id"), F.unix_micros("o_orderdate").alias("last_us"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("acknowledged").alias("state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "confirmed").when(F.col("o_orderpriority") == "2-HIGH", "false_positive").alias("disposition"), F.unix_micros("o_orderdate").alias("disposed_at"),
    )


def newest_incidents(spark, sf_dir):
    return V.newest(_incidents(spark, sf_dir), "resolved").select("incident_id", "last_us", "state")


def dispositioned_incidents(spark, sf_dir):
    return V.dispositioned(_incidents(spark, sf_dir)).select("incident_id", "disposition", "disposed_at")


def disposition_labels(spark, sf_dir):
    return V.disposition_labels(_incidents(spark, sf_dir), ["confirmed"])


def top_techniques(spark, sf_dir):
    """The two most frequent types of findings of each day."""
    return V.top_per(_e(spark, sf_dir), ["run_id"], "event_type", 2).select("run_id", "event_type", "n", "rank")


def entity_values(spark, sf_dir):
    """A user's events as an incident: the address, a host that was derived for every second event, a name in the title."""
    e = _e(spark, sf_dir)
    m = e.select(
        F.col("user_id").alias("incident"), F.lit("—").alias("entity"), F.array(F.concat(F.lit(" 10.0.0."), F.pmod("n", F.lit(5)).cast("string")), F.lit("high")).alias("chips"),
        F.col("host"), (F.pmod("n", F.lit(2)) == 0).alias("host_derived"), F.concat(F.lit("logins user="), F.col("event_type")).alias("title"),
    )
    return V.entity_values(m).select("incident", F.array_join("values", ",").alias("values"))


def report_chips(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    f = o.select(F.col("o_orderkey").alias("finding"), F.array(F.concat(F.lit("ip"), F.pmod("o_custkey", F.lit(40)).cast("string")), F.concat(F.lit("ip"), F.pmod("o_orderkey", F.lit(40)).cast("string"))).alias("ips"))
    two = F.array(*(F.struct(F.concat(F.lit(f"T{k}"), F.col("n_regionkey").cast("string")).alias("id"), F.col("n_name").alias("name")) for k in (1, 2)))
    none = F.array().cast("array<struct<id:string,name:string>>")
    r = n.select(F.concat(F.lit("ip"), F.col("n_nationkey").cast("string")).alias("value"), F.when(F.col("n_nationkey") > 20, F.lit(None)).otherwise(F.col("n_name")).alias("name"), F.when(F.pmod("n_nationkey", F.lit(2)) == 0, two).otherwise(none).alias("techniques"))
    return V.report_chips(f, r).select("finding", F.array_join("chips", "|").alias("chips"))


def evidence_records(spark, sf_dir):
    """The first record of a day that reads like the evidence of each type of event."""
    e = _e(spark, sf_dir)
    f = e.filter("event_type in ('error', 'signup')").select("run_id", "event_type", F.concat(F.lit("did "), "event_type", F.when(F.col("event_type") == "signup", "!").otherwise("")).alias("evidence")).distinct()
    return V.evidence_records(f, e.select("run_id", "n", "ts", F.col("body").alias("raw"))).select("run_id", "event_type", "n")


def span_steps(spark, sf_dir):
    """Order lines as records: first and last of the range that each order's second line opens."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_shipdate").alias("ts"))
    r = li.filter("n = 2").select("run_id", F.lit("f").alias("finding"), F.col("n").alias("lo"), (F.col("n") + 2).alias("hi")).distinct()
    d = V.span_steps(r, li.dropDuplicates(["run_id", "n"]))
    return d.select("run_id", "first_n", "last_n", "records")


def member_facts(spark, sf_dir):
    """Customers' orders as incidents' findings; those of odd number are not loaded."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    inc = o.groupBy(F.col("o_custkey").alias("incident")).agg(F.collect_set("o_orderkey").alias("finding_ids"))
    f = li.filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("finding")).agg(F.collect_set(F.col("l_partkey")).alias("lines"))
    return V.member_facts(inc, f).select("incident", "members", "loaded", "note", F.size("lines").alias("n_lines"))


def not_cited(spark, sf_dir):
    e = _e(spark, sf_dir)
    return V.not_cited(e, e.filter("event_type <> 'view'").select("run_id", F.col("n").alias("line")), 3).select("run_id", "n")


def event_search(spark, sf_dir):
    e = _e(spark, sf_dir).select("n", F.concat("host", F.lit(" "), "body").alias("raw"), F.lit(None).cast("string").alias("msg"))
    return V.search(e, ["HOST-7 did", "purchase9", "host-12 did sign"]).select("n", "raw")


def training_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("scenario"), F.col("l_linenumber").alias("line")).distinct()
    bad = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scenario"), F.col("l_linenumber").alias("line"), F.concat(F.lit("class-"), "l_linestatus").alias("class")).distinct()
    return V.training_labels(f, bad).groupBy("label").agg(F.count("*").alias("n"))


def run_scorecard(spark, sf_dir):
    """A rule (flag R) and a model (large quantity) against late lines, by line status."""
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_discount") > 0.05).alias("want"), F.explode(F.array(F.struct(F.lit("rules").alias("system"), (F.col("l_returnflag") == "R").alias("hit")), F.struct(F.lit("model").alias("system"), (F.col("l_quantity") > 30).alias("hit")))).alias("s"))
    one = lambda c: c.cast("int")
    c = li.select("l_linestatus", "s.system", one(F.col("s.hit") & F.col("want")).alias("tp"), one(F.col("s.hit") & ~F.col("want")).alias("fp"), one(~F.col("s.hit") & F.col("want")).alias("fn"))
    return V.run_scorecard(c, ["l_linestatus"])


def cross_case(spark, sf_dir):
    """The same events as canonical lines and as JSON lines give the same findings, but for one altered user."""
    e = _e(spark, sf_dir)
    a = E.canonical(e.select("run_id", "n", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ERROR "), "host", F.lit(" "), "body").alias("raw")))
    body = F.when(F.col("user_id") == 3, "did nothing").otherwise(F.col("body"))
    b = E.jsonlog(e.select("run_id", "n", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("error").alias("level"), "host", body.alias("msg"))).alias("raw")))
    cols = ["run_id", "ts", "level", "host", "msg"]
    return V.unequal(a.select(*cols), b.select(*cols)).groupBy("side", "host").agg(F.count("*").alias("n"))


def record_labels(spark, sf_dir):
    """Labels of events' times, one in ten without a time, and coerced fields."""
    e = table(spark, sf_dir, "events")
    t = V.labels_of(F.when(F.pmod("event_id", F.lit(10)) != 0, F.col("ts")))
    v = V.scalar(F.element_at(F.array(F.lit("TRUE"), F.lit("None"), F.lit(" x "), F.lit("False")), (F.pmod("event_id", F.lit(4)) + 1).cast("int")))
    return e.groupBy(t["day"].alias("day"), v.alias("value")).agg(F.count("*").alias("n"), F.min(t["clock"]).alias("clock"), F.max(t["iso"]).alias("iso"))


def universal_records(spark, sf_dir):
    """Fields under three namings, one line in four without a message."""
    e = _e(spark, sf_dir)
    k = F.pmod("n", F.lit(4))
    sec, level = F.unix_seconds("ts").cast("string"), F.lower("want_level")
    m = lambda *kv: F.create_map(*(x if not isinstance(x, str) else F.lit(x) for x in kv))
    fields = (
        F.when(k == 0, m("Time", sec, "severity", level, "msg", F.col("body"), "HostName", F.col("host")))
        .when(k == 1, m("timestamp", F.concat(sec, F.lit("000")), "LEVEL", level, "message", F.col("body"), "host", F.col("host")))
        .when(k == 2, m("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "priority", F.lit("odd"), "text", F.col("body"), "node", F.lit("null")))
        .otherwise(m("date", sec, "a", F.lit("b")))
    )
    d = V.bridge(V.universal(e.select("run_id", "n", F.lit("").alias("raw"), fields.alias("fields"))))
    return d.groupBy("run_id", "level").agg(F.count("*").alias("lines"), F.count_distinct("host").alias("hosts"), F.count_distinct("msg").alias("messages"), F.sum(F.unix_seconds("ts")).alias("sum_ts"))


# --- further line formats --------------------------------------------------------------------------------------------


def ingest_iso8601(spark, sf_dir):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), "host", F.lit(" app[9]: "), "event_type")
    return _summary(E.iso8601(_lines(spark, sf_dir, raw)))


def ingest_apache(spark, sf_dir):
    level = E.lookup({"error": "error", "purchase": "warn", "click": "info", "view": "debug", "signup": "crit"}, F.col("event_type"))
    raw = F.concat(F.lit("["), F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"), F.lit("] ["), level, F.lit("] "), "body")
    return _summary(E.apache(_lines(spark, sf_dir, raw)))


def ingest_thunderbird(spark, sf_dir):
    raw = F.concat(F.lit("- 1131566461 "), F.date_format("ts", "yyyy.MM.dd"), F.lit(" dn228 "), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" "), "host", F.lit(" "), "event_type")
    return _summary(E.thunderbird(_lines(spark, sf_dir, raw)))


def ingest_proxifier(spark, sf_dir):
    e = _e(spark, sf_dir)
    raw = F.concat(F.lit("["), F.date_format("ts", "MM.dd HH:mm:ss"), F.lit("] chrome.exe - "), F.when(F.col("event_type") == "error", "error : no route").otherwise(F.col("body")))
    out = None
    for year in (r["y"] for r in e.select(F.year("ts").alias("y")).distinct().collect()):  # a line has no year: one file a year
        one = E.proxifier(e.filter(F.year("ts") == year).select("run_id", "n", raw.alias("raw")), year)
        out = one if out is None else out.unionByName(one)
    return _summary(out)


def ingest_windows_cbs(spark, sf_dir):
    level = E.lookup({"error": "Error", "purchase": "Warning", "click": "Info", "view": "Verbose", "signup": "Critical"}, F.col("event_type"))
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(", "), level, F.lit("                  CBS    "), "body")
    return _summary(E.windows_cbs(_lines(spark, sf_dir, raw)))


def ingest_generic(spark, sf_dir):
    """Lines of no format: the time is found wherever it stands, in four notations."""
    k = F.pmod("n", F.lit(4))
    when = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.unix_seconds("ts").cast("string"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000"))
    )
    return _summary(E.generic(_lines(spark, sf_dir, F.concat(F.lit("at "), when, F.lit(" "), "event_type"))))


def ingest_forwarded(spark, sf_dir):
    """The date inside the message wins over the header's, the priority gives the level where no word does."""
    pri = E.lookup({"error": "27", "purchase": "28", "click": "30", "view": "31", "signup": "26"}, F.col("event_type"))
    raw = F.concat(F.lit("|"), pri, F.lit("|Jan 01 00:00:00 "), "host", F.lit(" app[5]: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" did it"))
    return _summary(E.forwarded(_lines(spark, sf_dir, raw)))


def datagrams(spark, sf_dir):
    """Syslog datagrams in both formats and bare text, with or without a host."""
    e = _e(spark, sf_dir)
    k = F.pmod("n", F.lit(3))
    text = (
        F.when(k == 0, F.concat(F.lit("<34>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" - app 1 ID - "), "body"))
        .when(k == 1, F.concat(F.lit("<13>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" "), "body")).otherwise(F.col("body"))
    )
    d = e.select(E.datagram(text, F.col("ip")).alias("d"), "ip", "host", "body")
    return d.groupBy(F.coalesce("d.facility", F.lit("-")).alias("facility"), F.coalesce("d.severity", F.lit("-")).alias("severity"), F.col("d.host_given").alias("host_given")).agg(
        F.count("*").alias("n"), F.count_if(F.col("d.message") == F.col("body")).alias("whole"), F.count_distinct("d.host").alias("hosts")
    )


def collector_kinds(spark, sf_dir):
    """Collector events of three kinds with severity words and numbers."""
    e = _e(spark, sf_dir)
    k = F.pmod("n", F.lit(4))
    js = (
        F.when(k == 0, F.to_json(F.struct(F.lit("a.exe").alias("process_name"), F.lit("85").alias("severity"), "host")))
        .when(k == 1, F.to_json(F.struct(F.col("ip").alias("src_ip"), F.lit("Warning").alias("level"), F.struct(F.col("host").alias("hostname")).alias("device"))))
        .when(k == 2, F.to_json(F.struct(F.lit("x").alias("eventName"), F.struct(F.col("event_type").alias("userName")).alias("userIdentity"))))
        .otherwise(F.lit("{broken"))
    )
    d = S.collector_events(e.select("n", js.alias("json")))
    return d.groupBy("kind", "severity", "unparsed").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.count_distinct("src_ip").alias("ips"), F.count_distinct("user").alias("users"))


def webhook_batches(spark, sf_dir):
    """A day's events in one payload, unwrapped; accepted, stored, duplicate and unparsed counts."""
    e = _e(spark, sf_dir)
    one = F.to_json(F.struct(F.col("event_type").alias("kind"), F.pmod("n", F.lit(50)).alias("k")))
    p = e.groupBy("run_id").agg(F.concat(F.lit('{"events":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("json"))
    got = S.unwrap_batches(p)
    stored = sinks.first_of(got.withColumn("h", F.sha2("json", 256)), ["run_id", "h"], ["json"])
    return got.groupBy("run_id").agg(F.count("*").alias("accepted"), F.count_if(F.try_parse_json("json").isNull()).alias("unparsed")).join(stored.groupBy("run_id").agg(F.count("*").alias("stored")), "run_id").withColumn("duplicates", F.col("accepted") - F.col("stored"))


def vendor_payloads(spark, sf_dir):
    e = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list(F.to_json(F.struct(F.col("o_orderstatus").alias("z"), F.col("o_orderkey").alias("a")))), ","), F.lit("]}")).alias("json"))
    d = S.vendor_events(e)
    return d.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("raw").alias("first_raw"), F.sum(F.element_at("fields", "a").cast("long")).alias("keys"))


def event_xml(spark, sf_dir):
    """Events as XML, one in eight broken."""
    e = _e(spark, sf_dir)
    level = E.lookup({"error": "2", "purchase": "3", "click": "4", "view": "9", "signup": "1"}, F.col("event_type"))
    xml = F.concat(
        F.lit("<Event><System><EventID>"), (F.pmod("n", F.lit(5)) + 4620).cast("string"), F.lit("</EventID><Level>"), level, F.lit("</Level><Computer>"), "host",
        F.lit("</Computer><TimeCreated SystemTime='"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("'/></System><EventData><Data Name='u'>"), "event_type", F.lit("</Data></EventData></Event>"),
    )
    d = S.event_xml(e.select("n", F.when(F.pmod("n", F.lit(8)) == 0, "<Event><Sys").otherwise(xml).alias("xml")))
    return d.groupBy("event_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.sum(F.unix_seconds("ts")).alias("sum_ts"), F.max("message").alias("message"))


def splunk_export(spark, sf_dir):
    e = _e(spark, sf_dir)
    inner = F.struct(F.col("host"), F.col("event_type").alias("kind"))
    raw = F.when(F.pmod("n", F.lit(2)) == 0, F.to_json(F.struct(inner.alias("result")))).when(F.pmod("n", F.lit(10)) == 9, F.lit("not json")).otherwise(F.to_json(inner))
    d = S.splunk_export(e.select("run_id", "n", raw.alias("raw")))
    return d.groupBy(F.element_at("fields", "kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(F.element_at("fields", "host")).alias("hosts"))


# --- rules and enrichment -------------------------------------------------------------------------------------------


def core_rules(spark, sf_dir):
    """Outbound ports, disk pressure, critical events, break-ins and Windows event ids over one table of records."""
    e = _e(spark, sf_dir)
    k = F.pmod("user_id", F.lit(100))
    msg = (
        F.when(F.col("event_type") == "click", F.format_string("connection to 203.0.113.7:%d", F.when(k < 10, 4444).when(k < 20, 6667).otherwise(443)))
        .when(F.col("event_type") == "view", F.format_string("disk usage at %d%% on /", k))
        .when(F.col("event_type") == "purchase", F.format_string("reverse mapping checking [198.51.100.%d] failed - POSSIBLE BREAK-IN ATTEMPT!", F.pmod("user_id", F.lit(7))))
        .otherwise("service down")
    )
    fields = F.when(F.col("event_type") == "error", F.create_map(F.lit("event_id"), F.when(k < 50, "1102").otherwise("7045")))
    r = e.select("run_id", "n", "ts", F.when(F.col("event_type") == "signup", "CRIT").otherwise("INFO").alias("level"), "host", msg.alias("msg"), msg.alias("raw"), fields.alias("fields"))
    parts = [rules.suspicious_outbound(r), rules.disk_pressure(r), rules.critical_events(r), rules.break_ins(r), rules.windows_events(r)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pass_no", "severity", "type").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"))


def merged_anomalies(spark, sf_dir):
    """Anomalies of equal run, type and summary become one: occurrences add up, the first stays."""
    e = _e(spark, sf_dir)
    a = rules.found(e, 3, F.col("severity"), F.col("event_type"), F.lit("seen"), F.col("body"), F.col("host"), F.col("n"))
    return rules.merge_same(a).select("run_id", "type", "occurrences", "severity", "seq", "entity")


def indicators_seen(spark, sf_dir):
    e = _e(spark, sf_dir).select("run_id", "n", F.concat(F.lit("peer "), "ip", F.lit(" and 9.9.9.9")).alias("raw"))
    d = investigate.indicators(e)
    return d.filter("ioc_type = 'ipv4'").groupBy("run_id").agg(F.count("*").alias("values"), F.sum("n_records").alias("records"), F.min("first_n").alias("first_n"))


def findings_page(spark, sf_dir):
    """One page of the urgent findings on a host, in order of severity, with the total."""
    e = _e(spark, sf_dir).select("severity", F.col("event_type").alias("type"), "host", F.col("n").alias("seq"))
    page, total = enrich.findings_page(e, host="HOST-1", limit=40)
    return page.crossJoin(F.broadcast(total)).select("seq", "severity", "host", "total", "truncated")


def dashboard(spark, sf_dir):
    e = _e(spark, sf_dir)
    inc = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("low").alias("severity"))
    return enrich.dashboard(e.select("severity", "host"), inc)


def grounded_claims(spark, sf_dir):
    e = _e(spark, sf_dir)
    text = F.concat(F.lit("from "), "ip", F.when(F.pmod("n", F.lit(3)) == 0, " via 8.8.8.8").otherwise(""))
    d = investigate.grounded(e.select(text.alias("text"), F.array("ip").alias("facts"), "event_type"), "text", "facts")
    return d.groupBy("event_type", "ok").agg(F.count("*").alias("n"), F.max(F.array_join("ungrounded", ",")).alias("ungrounded"))


def feed_ceiling(spark, sf_dir):
    """A feed lowers a severity, never raises it."""
    e = _e(spark, sf_dir)
    kinds = F.when(F.pmod("user_id", F.lit(2)) == 0, F.array(F.lit("malicious-activity")))
    tech = F.when(F.pmod("n", F.lit(2)) == 0, F.array(F.lit("T1")))
    return intel.feed_ceiling(e.select("severity", kinds.alias("indicator_types"), tech.alias("techniques"))).groupBy("ceiling", "severity").agg(F.count("*").alias("n"))


def provider_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = li.select(F.pmod("l_partkey", F.lit(13)).cast("int").alias("pulses"), F.when(F.pmod("l_orderkey", F.lit(3)) == 0, F.col("l_quantity").cast("int")).alias("confidence"))
    return intel.provider_verdict(r).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def best_iocs(spark, sf_dir):
    """The worst finding of each address, the first among equals."""
    e = _e(spark, sf_dir).select("severity", F.col("n").alias("seq"), F.concat(F.lit("10.0."), F.pmod("user_id", F.lit(50)).cast("string"), F.lit("."), F.pmod("n", F.lit(9)).cast("string")).alias("ip"))
    return intel.best_per_value(e, F.col("ip"), "HIGH").select("value", "severity", "seq")


def stored_incidents(spark, sf_dir):
    """Derived incidents take the analyst's state of stored ones; stored ones that are not derived any more stay."""
    o = table(spark, sf_dir, "orders")
    derived = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderpriority").alias("severity"))
    stored = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("incident_id"), F.lit("old").alias("severity"), F.col("o_orderstatus").alias("state"))
    d = I.merge_stored(derived, stored, ["state"])
    return d.groupBy("severity", F.coalesce("state", F.lit("-")).alias("state")).agg(F.count("*").alias("n"))


def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.when(F.pmod("event_id", F.lit(20)) != 0, F.col("ts")))
    keep, gone = sinks.retain(e, "ts", F.lit("2024-01-15").cast("timestamp"))
    return keep.agg(F.count("*").alias("kept")).crossJoin(gone)


def run_report(spark, sf_dir):
    c, d = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    f = c.select(F.col("conv_id").alias("run_id"), F.when(F.col("role") == "assistant", "model").otherwise("rule").alias("source"))
    return sinks.report(f, d.select(F.col("doc_id").alias("run_id"), F.coalesce("text", F.lit("")).alias("content")))


def merged_recall(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule_id"), (F.col("l_quantity") > 30).cast("int").alias("hit"), F.lit(1).alias("expected"))
    return score.merged_recall(li)


QUERIES = {f.__name__: f for f in (
    user_rollup, store_figures, source_status, store_defaults, newest_incidents, dispositioned_incidents, disposition_labels, top_techniques, entity_values, report_chips,
    evidence_records, span_steps, member_facts, not_cited, event_search, training_labels, run_scorecard, cross_case, record_labels, universal_records, ingest_iso8601,
    ingest_apache, ingest_thunderbird, ingest_proxifier, ingest_windows_cbs, ingest_generic, ingest_forwarded, datagrams, collector_kinds, webhook_batches, vendor_payloads,
    event_xml, splunk_export, core_rules, merged_anomalies, indicators_seen, findings_page, dashboard, grounded_claims, feed_ceiling, provider_scores, best_iocs,
    stored_incidents, retention, run_report, merged_recall,
)}

_WORDS = "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END"
_F = f"(SELECT *, event_id AS n, {_DAY} AS run_id, {_SEV} AS severity, 'host-' || user_id AS host, '10.' || (user_id % 200) || '.' || (event_id % 250) || '.7' AS ip FROM events)"
_INC = """(SELECT o_orderkey AS incident_id, epoch_us(o_orderdate) AS last_us, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'acknowledged' END AS state,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'confirmed' WHEN '2-HIGH' THEN 'false_positive' END AS disposition FROM orders)"""
_NONE = "CAST(0 AS BIGINT)"
ORACLES = {
    "user_rollup": """
WITH e AS (SELECT 'u' || (user_id % 97) AS name, event_type, event_id % 3 AS k FROM events),
a AS (SELECT name, count(*) FILTER (WHERE k < 2) AS events, count(*) FILTER (WHERE event_type = 'error') AS findings FROM e GROUP BY 1)
SELECT name, events, findings, findings * 5 AS risk, CASE WHEN findings > 0 THEN 'HIGH' END AS worst FROM a WHERE events > 0 OR findings > 0""",
    "store_figures": """SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_type = 'signup') AS critical, (SELECT count(*) FROM events WHERE event_type = 'error') AS high,
  (SELECT count(*) FROM customer) AS assets, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_vulnerabilities, (SELECT count(*) FROM supplier WHERE s_acctbal < 1000) AS ioc_hits""",
    "source_status": """SELECT k AS source_type, (SELECT count(*) FROM events WHERE event_type = k) AS n FROM (VALUES ('click'), ('error'), ('syslog'), ('view')) v(k) UNION ALL SELECT NULL, count(*) FROM events""",
    "store_defaults": """
SELECT 'asset' AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 'crown-jewel' ELSE 'standard' END || '|' AS value, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'vulnerability', CASE l_returnflag WHEN 'R' THEN 'HIGH' ELSE 'INFO' END || '|' || CASE l_linestatus WHEN 'F' THEN 'fixed' ELSE 'open' END || '|' || CASE WHEN l_discount > 0.05 THEN '5' ELSE '0' END, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'ioc', CASE WHEN s_acctbal < 0 THEN 'malicious' ELSE 'unknown' END || '|0', count(*) FROM supplier GROUP BY 2""",
    "newest_incidents": f"SELECT incident_id, last_us, state FROM {_INC} WHERE state = 'resolved'",
    "dispositioned_incidents": f"SELECT incident_id, disposition, last_us AS disposed_at FROM {_INC} WHERE disposition IS NOT NULL",
    "disposition_labels": f"SELECT incident_id, disposition AS label FROM {_INC} WHERE state = 'resolved' AND disposition = 'confirmed'",
    "top_techniques": f"""
WITH c AS (SELECT run_id, event_type, count(*) AS n FROM {_F} GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n DESC, event_type) AS INTEGER) AS rank FROM c)
SELECT * FROM k WHERE rank <= 2""",
    "entity_values": """
WITH v AS (SELECT user_id AS incident, '10.0.0.' || (event_id % 5) AS v FROM events UNION SELECT user_id, 'host-' || user_id FROM events WHERE event_id % 2 = 0 UNION SELECT user_id, event_type FROM events)
SELECT incident, string_agg(v, ',' ORDER BY v) AS "values" FROM v GROUP BY incident""",
    "report_chips": """
WITH i AS (SELECT o_orderkey AS finding, o_custkey % 40 AS k FROM orders UNION SELECT o_orderkey, o_orderkey % 40 FROM orders),
c AS (SELECT finding, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['T1' || n_regionkey || ' · ' || n_name, 'T2' || n_regionkey || ' · ' || n_name]
   WHEN n_nationkey > 20 THEN ['threat-intel match'] ELSE [n_name] END) AS c FROM i JOIN nation ON n_nationkey = k)
SELECT finding, string_agg(c, '|' ORDER BY c) AS chips FROM c GROUP BY finding""",
    "evidence_records": f"""
WITH f AS (SELECT DISTINCT run_id, event_type FROM {_F} WHERE event_type IN ('error', 'signup'))
SELECT run_id, event_type, CASE event_type WHEN 'error' THEN (SELECT min(n) FROM {_F} e WHERE e.run_id = f.run_id AND e.event_type = 'error') END AS n FROM f""",
    "span_steps": """
WITH l AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS n FROM lineitem)
SELECT r AS run_id, CAST(min(n) AS BIGINT) AS first_n, CAST(max(n) AS BIGINT) AS last_n, count(*) AS records FROM l WHERE n BETWEEN 2 AND 4 GROUP BY r HAVING min(n) = 2""",
    "member_facts": """
WITH p AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_orderkey % 2 = 0), h AS (SELECT DISTINCT k FROM p),
a AS (SELECT o_custkey AS incident, count(DISTINCT o_orderkey) AS members, count(DISTINCT h.k) AS loaded FROM orders LEFT JOIN h ON k = o_orderkey GROUP BY 1),
b AS (SELECT o_custkey AS incident, count(DISTINCT p) AS l FROM orders LEFT JOIN p ON k = o_orderkey GROUP BY 1)
SELECT a.incident, members, loaded, CASE WHEN loaded < members THEN loaded || ' of ' || members || ' findings loaded' END AS note, CAST(l AS INTEGER) AS n_lines FROM a JOIN b USING (incident)""",
    "not_cited": f"WITH k AS (SELECT run_id, n, row_number() OVER (PARTITION BY run_id ORDER BY n) AS k FROM {_F} WHERE event_type = 'view') SELECT run_id, n FROM k WHERE k <= 3",
    "event_search": f"SELECT n, host || ' did ' || event_type AS raw FROM {_F} WHERE contains(host || ' did ' || event_type, 'host-7 did') OR contains(host || ' did ' || event_type, 'host-12 did sign') ORDER BY n LIMIT 12",
    "training_labels": """
WITH f AS (SELECT DISTINCT l_orderkey AS s, l_linenumber AS l FROM lineitem), b AS (SELECT l_orderkey AS s, l_linenumber AS l, max('class-' || l_linestatus) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT coalesce(c, 'noise') AS label, count(*) AS n FROM f LEFT JOIN b USING (s, l) GROUP BY 1""",
    "run_scorecard": """
WITH c AS (SELECT l_linestatus, s AS system, CASE s WHEN 'rules' THEN l_returnflag = 'R' ELSE l_quantity > 30 END AS h, l_discount > 0.05 AS w FROM lineitem, (VALUES ('rules'), ('model')) v(s)),
g AS (SELECT l_linestatus, system, count(*) FILTER (WHERE h AND w) AS tp, count(*) FILTER (WHERE h AND NOT w) AS fp, count(*) FILTER (WHERE w AND NOT h) AS fn FROM c GROUP BY GROUPING SETS ((l_linestatus, system), (system)))
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM g""",
    "cross_case": "SELECT side, 'host-3' AS host, count(*) AS n FROM events, (VALUES ('first'), ('second')) v(side) WHERE user_id = 3 GROUP BY side",
    "record_labels": """
WITH e AS (SELECT CASE WHEN event_id % 10 <> 0 THEN ts END AS t, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 2 THEN 'x' WHEN 3 THEN 'false' END AS value FROM events)
SELECT coalesce(strftime(t, '%Y-%m-%d'), '—') AS day, value, count(*) AS n, min(coalesce(strftime(t, '%H:%M:%S'), '—')) AS clock, max(coalesce(strftime(t, '%Y-%m-%dT%H:%M:%SZ'), '—')) AS iso FROM e GROUP BY 1, 2""",
    "universal_records": f"""
WITH e AS (SELECT *, event_id % 4 AS k, CASE event_id % 4 WHEN 2 THEN 'ODD' WHEN 3 THEN '' ELSE CASE event_type WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'ERROR' END END AS level FROM {_F})
SELECT run_id, level, count(*) AS lines, count(DISTINCT CASE WHEN k < 2 THEN host ELSE '' END) AS hosts,
  count(DISTINCT CASE WHEN k < 3 THEN event_type ELSE CAST({_SEC} AS VARCHAR) END) AS messages, CAST(sum({_SEC}) AS BIGINT) AS sum_ts FROM e GROUP BY 1, 2""",
    "ingest_iso8601": _ORACLE.format(level=_WORDS, hosts=_HOSTS, ts=_SEC),
    "ingest_apache": _ORACLE.format(level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END", hosts=_NONE, ts=_SEC),
    "ingest_thunderbird": _ORACLE.format(level=_WORDS, hosts=_HOSTS, ts=_SEC),
    "ingest_proxifier": _ORACLE.format(level=_WORDS, hosts=_NONE, ts=_SEC),
    "ingest_windows_cbs": _ORACLE.format(level=_CASE, hosts=_NONE, ts=_SEC),
    "ingest_generic": _ORACLE.format(level=_WORDS, hosts=_NONE, ts=_SEC),
    "ingest_forwarded": _ORACLE.format(level="CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'CRIT' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END", hosts=_HOSTS, ts=_SEC),
    "datagrams": f"""
SELECT CASE k WHEN 0 THEN 'auth' WHEN 1 THEN 'user' ELSE '-' END AS facility, CASE k WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'NOTICE' ELSE '-' END AS severity, k = 1 AS host_given, count(*) AS n, count(*) AS whole,
  CASE k WHEN 1 THEN count(DISTINCT host) ELSE count(DISTINCT ip) END AS hosts FROM (SELECT *, n % 3 AS k FROM {_F}) GROUP BY k""",
    "collector_kinds": f"""
SELECT CASE k WHEN 0 THEN 'edr' WHEN 1 THEN 'firewall' WHEN 2 THEN 'cloud' ELSE 'webhook' END AS kind, CASE k WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'info' END AS severity, k = 3 AS unparsed, count(*) AS n,
  CASE WHEN k < 2 THEN count(DISTINCT host) ELSE 0 END AS hosts, CASE k WHEN 1 THEN count(DISTINCT ip) ELSE 0 END AS ips, CASE k WHEN 2 THEN count(DISTINCT event_type) ELSE 0 END AS users FROM (SELECT *, n % 4 AS k FROM {_F}) GROUP BY k""",
    "webhook_batches": f"WITH g AS (SELECT run_id, count(*) AS accepted, count(DISTINCT event_type || (n % 50)) AS stored FROM {_F} GROUP BY 1) SELECT run_id, accepted, CAST(0 AS BIGINT) AS unparsed, stored, accepted - stored AS duplicates FROM g",
    "vendor_payloads": """SELECT o_custkey, count(*) AS n, min('{"a":"' || o_orderkey || '","z":"' || o_orderstatus || '"}') AS first_raw, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
    "event_xml": f"""
WITH e AS (SELECT *, n % 8 = 0 AS bad FROM {_F})
SELECT CASE WHEN NOT bad THEN CAST(n % 5 + 4620 AS VARCHAR) END AS event_id, CASE WHEN bad THEN 'info' ELSE CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'click' THEN 'low' WHEN 'view' THEN 'info' ELSE 'critical' END END AS severity,
  count(*) AS n, count(DISTINCT CASE WHEN NOT bad THEN host END) AS hosts, CAST(sum(CASE WHEN NOT bad THEN {_SEC} END) AS BIGINT) AS sum_ts, max(CASE WHEN NOT bad THEN 'u=' || event_type END) AS message FROM e GROUP BY 1, 2""",
    "splunk_export": f"SELECT event_type AS kind, count(*) AS n, count(DISTINCT host) AS hosts FROM {_F} WHERE n % 10 <> 9 GROUP BY 1",
    "core_rules": f"""
WITH e AS (SELECT *, user_id % 100 AS k FROM {_F}), b AS (SELECT run_id, user_id % 7 AS a, count(*) AS o FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT 1 AS pass_no, 'high' AS severity, 'suspicious_outbound' AS type, count(*) AS n, count(*) AS occurrences FROM e WHERE event_type = 'click' AND k < 20 HAVING count(*) > 0
UNION ALL SELECT 2, CASE WHEN k >= 90 THEN 'high' ELSE 'medium' END, 'disk_pressure', count(*), count(*) FROM e WHERE event_type = 'view' AND k >= 80 GROUP BY 2
UNION ALL SELECT 2, 'critical', 'critical_service_event', count(*), count(*) FROM e WHERE event_type = 'signup' HAVING count(*) > 0
UNION ALL SELECT 4, 'medium', 'possible_break_in', count(*), CAST(sum(o) AS BIGINT) FROM b HAVING count(*) > 0
UNION ALL SELECT 5, CASE WHEN k < 50 THEN 'critical' ELSE 'high' END, CASE WHEN k < 50 THEN 'windows_audit_log_cleared' ELSE 'windows_service_installed' END, count(*), count(*) FROM e WHERE event_type = 'error' GROUP BY 2, 3""",
    "merged_anomalies": f"SELECT run_id, event_type AS type, count(*) AS occurrences, any_value(severity) AS severity, min(n) AS seq, arg_min(host, n) AS entity FROM {_F} GROUP BY 1, 2",
    "indicators_seen": f"WITH v AS (SELECT run_id, n, ip FROM {_F} UNION ALL SELECT run_id, n, '9.9.9.9' FROM {_F}) SELECT run_id, count(DISTINCT ip) AS \"values\", count(*) AS records, min(n) AS first_n FROM v GROUP BY 1",
    "findings_page": f"""
WITH h AS (SELECT *, count(*) OVER () AS total FROM {_F} WHERE contains(host, 'host-1'))
SELECT n AS seq, severity, host, total, total > 40 AS truncated FROM h ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, n LIMIT 40""",
    "dashboard": f"""SELECT count(*) AS findings, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS urgent, count(DISTINCT host) AS hosts, (SELECT count(*) FROM orders) AS incidents,
  (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS critical_incidents FROM {_F}""",
    "grounded_claims": f"SELECT event_type, n % 3 <> 0 AS ok, count(*) AS n, CASE WHEN any_value(n % 3) = 0 THEN '8.8.8.8' ELSE '' END AS ungrounded FROM {_F} GROUP BY 1, 2",
    "feed_ceiling": f"""
WITH e AS (SELECT {{'CRITICAL': 0, 'HIGH': 1, 'MEDIUM': 2, 'LOW': 3, 'INFO': 4}} AS r, severity AS s, CASE WHEN user_id % 2 = 0 AND n % 2 = 0 THEN 'CRITICAL' WHEN user_id % 2 = 0 THEN 'HIGH' WHEN n % 2 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS ceiling FROM {_F})
SELECT ceiling, CASE WHEN CASE s WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END < CASE ceiling WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END THEN ceiling ELSE s END AS severity, count(*) AS n FROM e GROUP BY 1, 2""",
    "provider_scores": """
WITH l AS (SELECT l_partkey % 13 AS p, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_quantity AS INTEGER) END AS c FROM lineitem), s AS (SELECT *, CASE WHEN c IS NOT NULL THEN c ELSE least(100, p * 10) END AS score FROM l)
SELECT CASE WHEN (c IS NOT NULL AND c >= 50) OR (c IS NULL AND p >= 5) THEN 'malicious' WHEN score > 0 THEN 'suspicious' ELSE 'clean' END AS verdict, count(*) AS n, CAST(sum(score) AS DOUBLE) AS score FROM s GROUP BY 1""",
    "best_iocs": f"""
WITH e AS (SELECT '10.0.' || (user_id % 50) || '.' || (n % 9) AS value, severity, n FROM {_F} WHERE severity IN ('CRITICAL', 'HIGH')), k AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY severity, n) AS k FROM e)
SELECT value, severity, n AS seq FROM k WHERE k = 1""",
    "stored_incidents": """
SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'old' END AS severity, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '-' END AS state, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1, 2""",
    "retention": "SELECT count(*) FILTER (WHERE event_id % 20 = 0 OR ts >= TIMESTAMP '2024-01-15') AS kept, count(*) FILTER (WHERE event_id % 20 <> 0 AND ts < TIMESTAMP '2024-01-15') AS removed FROM events",
    "run_report": """
WITH p AS (SELECT conv_id AS r, count(*) AS f, count(*) FILTER (WHERE role = 'assistant') AS m FROM conversations GROUP BY 1)
SELECT doc_id AS run_id, sha256(coalesce(text, '')) AS input_sha256, coalesce(f, 0) AS findings, coalesce(m, 0) AS model, coalesce(f - m, 0) AS rules FROM documents LEFT JOIN p ON r = doc_id""",
    "merged_recall": """SELECT l_returnflag AS rule_id, count(*) FILTER (WHERE l_quantity > 30) AS hit, count(*) AS expected, round(count(*) FILTER (WHERE l_quantity > 30) / count(*), 4) AS recall FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
}
