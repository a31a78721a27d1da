from datetime import datetime

from loomwatch.sources import envelopes as E, lines as L, sinks, structured as S


def lines_of(spark, text, run="r"):
    return spark.createDataFrame([(run, k + 1, x) for k, x in enumerate(text)], "run_id string, n long, raw string")


def one(spark, parser, line, **kw):
    r = parser(lines_of(spark, [line]), **kw).collect()
    assert len(r) == 1
    return r[0]


def test_numbers_across_splits(spark, tmp_path):
    want = {}
    for f in range(3):
        rows = [f"{f}-{k}" + "x" * (k % 50) if k % 7 else "" for k in range(4000)]
        (tmp_path / f"f{f}.log").write_text("\n".join(rows) + "\n")
        want |= {(f, k + 1): x for k, x in enumerate(rows)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(int(r.run_id[-5]), r.n): r.raw for r in L.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_encodings(spark, tmp_path):
    (tmp_path / "a").write_bytes("héllo".encode())
    (tmp_path / "b").write_bytes("hello there".encode("utf-16le"))
    (tmp_path / "c").write_bytes(b"caf\xe9 \x93quoted\x94")
    (tmp_path / "d").write_bytes(b"\xef\xbb\xbfx")
    got = {r.run_id[-1]: r.encoding for r in L.file_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a": "utf-8", "b": "utf-16le", "c": "windows-1252", "d": "utf-8"}


def test_formats(spark):
    r = one(spark, E.apache, "[Sun Dec  4 04:47:44 2005] [error] mod_jk child in error state 6")
    assert (r.ts, r.level) == (datetime(2005, 12, 4, 4, 47, 44), "ERROR")
    r = one(spark, E.thunderbird, "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond[2915]: session closed")
    assert (r.ts, r.host) == (datetime(2005, 11, 9, 12, 1, 1), "dn228/dn228")
    r = one(spark, E.proxifier, "[10.30 16:49:06] chrome.exe - proxy.example:5070 error : could not connect", base_year=2024)
    assert (r.ts, r.level, r.proc) == (datetime(2024, 10, 30, 16, 49, 6), "ERROR", "chrome.exe")
    r = one(spark, E.windows_cbs, "2016-09-28 04:30:30, Info                  CBS    Loaded Servicing Stack")
    assert (r.level, r.proc, r.msg) == ("INFO", "CBS", "Loaded Servicing Stack")
    r = one(spark, E.iso8601, "2024-05-01T10:00:00+02:00 web sshd[12]: Failed password for x from 10.0.0.1")
    assert (r.ts, r.host, r.proc, r.pid, r.level) == (datetime(2024, 5, 1, 8), "web", "sshd", "12", "WARN")
    assert E.iso8601(lines_of(spark, ["2024-05-01T10:00:00Z INFO host text"])).count() == 0


def test_rollover_and_impossible_dates(spark):
    text = ["Dec 31 23:59:59 h a: x", "Feb 30 00:00:00 h a: x", "Jan  1 00:00:01 h a: y", "Jan  2 00:00:01 h a: z"]
    r = E.rfc3164(lines_of(spark, text), 2023).orderBy("n").collect()
    assert [x.ts for x in r] == [datetime(2023, 12, 31, 23, 59, 59), None, datetime(2024, 1, 1, 0, 0, 1), datetime(2024, 1, 2, 0, 0, 1)]


def test_coverage_verdicts(spark):
    text = lines_of(spark, ["2024-05-01T10:00:00Z INFO host text", "", "???"], "a").union(lines_of(spark, ["???", "!!!"], "b")).union(lines_of(spark, ["", " "], "c"))
    got = {r.run_id: (r.total, r.parsed, r.unparsed, r.verdict, r.examples) for r in L.coverage(text, E.canonical(text)).collect()}
    assert got == {"a": (2, 1, 1, "parsed", ["???"]), "b": (2, 0, 2, "unrecognised", ["???", "!!!"]), "c": (0, 0, 0, "empty", None)}
    assert {r.run_id: r.format for r in L.sniff(text).collect()} == {"a": "canonical", "b": "unknown", "c": "empty"}


def test_json_documents_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"msg": "x"}, {"msg": "y"}]}')
    (tmp_path / "b.json").write_text('[{"msg": "z"}]')
    got = sorted((r.run_id[-6:], r.n, r.raw) for r in S.json_documents(spark, str(tmp_path)).collect())
    assert got == [("a.json", 1, '{"msg":"x"}'), ("a.json", 2, '{"msg":"y"}'), ("b.json", 1, '{"msg":"z"}')]
    good, bad = S.json_lines(lines_of(spark, ['{"a": "1"}', "{bad", ""]))
    assert (good.count(), [r.raw for r in bad.collect()]) == (1, ["{bad"])
    assert S.sniff_delimiter(lines_of(spark, ["a;b;c", "1;2,5;3"])).first().sep == ";"


def test_auth_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,IP_Address,Username,Status,Source\n2024-05-01T10:00:00Z,203.0.113.5,bob,FAILED,vpn\n,,,,\n")
    r = S.auth_csv(S.csv_rows(spark, str(tmp_path))).collect()
    assert [(x.ts, x.host, x.fields["status"]) for x in r] == [(datetime(2024, 5, 1, 10), "vpn", "FAILED")]


def test_windows_text(spark):
    text = ["junk", "9/1/2024 8:05:02 AM", "LogName=Security", "EventCode=4625", "Message=An account", "failed to log on", "9/1/2024 8:06:00 AM", "Message=ok"]
    r = S.windows_text(lines_of(spark, text)).orderBy("n").collect()
    assert [(x.n, x.msg) for x in r] == [(2, "An account\nfailed to log on"), (7, "ok")] and r[0].fields["eventcode"] == "4625"


def test_event_xml(spark):
    good = "<Event><System><EventID>4625</EventID><Level>2</Level><Computer>pc</Computer></System><EventData><Data Name='a'>1</Data><Data Name='b'>2</Data></EventData></Event>"
    r = {x.k: x for x in S.event_xml(spark.createDataFrame([(1, good), (2, "<Event><broken")], "k int, xml string")).collect()}
    assert (r[1].event_id, r[1].severity, r[1].host, r[1].message) == ("4625", "high", "pc", "a=1 b=2") and r[2].event_id is None


def test_collectors(spark):
    rows = [(1, '{"process_name": "x", "severity": 85, "device": {"hostname": "pc"}}'), (2, '{"src_ip": "10.0.0.1", "action": "deny", "level": "warning"}'), (3, "nope")]
    r = {x.k: x for x in S.collector_events(spark.createDataFrame(rows, "k int, json string")).collect()}
    assert (r[1].kind, r[1].severity, r[1].host) == ("edr", "critical", "pc")
    assert (r[2].kind, r[2].severity, r[2].src_ip) == ("firewall", "medium", "10.0.0.1") and r[3].unparsed
    packs = [(1, '{"events": [{"a": 1}, {"a": 2}]}'), (2, '{"event": {"a": 3}}'), (3, '{"a": 4}')]
    assert sorted(x.json.replace(" ", "") for x in S.unwrap_batches(spark.createDataFrame(packs, "k int, json string")).collect()) == [f'{{"a":{k}}}' for k in (1, 2, 3, 4)]


def test_scan_reports_and_context(spark, tmp_path):
    (tmp_path / "scan.xml").write_text(
        "<nmaprun><host><status state='up'/><address addr='10.0.0.5' addrtype='ipv4'/><hostnames><hostname name='db'/></hostnames><ports>"
        "<port protocol='tcp' portid='22'><state state='open'/><service name='ssh'/></port><port protocol='tcp' portid='23'><state state='closed'/></port></ports></host>"
        "<host><status state='down'/><address addr='10.0.0.6' addrtype='ipv4'/></host></nmaprun>"
    )
    r = S.scan_hosts(spark, str(tmp_path / "scan.xml")).collect()
    assert [(x.ip, x.host, x.ports, x.services) for x in r] == [("10.0.0.5", "db", ["22/tcp"], ["ssh"])]
    (tmp_path / "org.json").write_text('{"assets": {"DB": {"criticality": "crown-jewel", "owner": "x"}, "web": {"criticality": "??"}}}')
    got = {x.asset: x.criticality for x in S.org_context(spark, str(tmp_path / "org.json")).collect()}
    assert got == {"db": "crown-jewel", "web": "standard"}


def test_store_appends_once(spark, tmp_path):
    e = spark.createDataFrame([(datetime(2024, 1, 1), "s", "a"), (datetime(2024, 1, 1), "s", "a"), (datetime(2024, 1, 2), "s", "b")], "ts timestamp, source string, raw string")
    path = str(tmp_path / "store")
    sinks.append_new(e, path)
    sinks.append_new(e.union(spark.createDataFrame([(datetime(2024, 1, 3), "s", "c")], e.schema)), path)
    assert sorted(r.raw for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    kept, gone = sinks.retain(spark.read.parquet(path), "ts", __import__("pyspark").sql.functions.lit("2024-01-02").cast("timestamp"))
    assert (kept.count(), gone.first().removed) == (2, 1)


def test_exports(spark, tmp_path):
    f = spark.createDataFrame([(1, ["T1", "T2"])], "id int, techniques array<string>")
    for fmt in ("csv", "json", "xml"):
        sinks.export_findings(f, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().techniques == "T1; T2"
    assert spark.read.format("xml").option("rowTag", "finding").load(str(tmp_path / "xml")).first().id == 1


def test_running_sums_in_blocks_equal_those_of_the_run(spark):
    import random

    from pyspark.sql import Window as W, functions as F

    from loomwatch.functions.prefix import before_in_run, running_sum

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([1, 2, None])) for n in rng.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "run_id string, n long, v int")
    w = W.partitionBy("run_id").orderBy("n")
    want = sorted((r.run_id or "", r.n, r.s, r.p) for r in df.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w)).withColumn("p", F.lag("v").over(w)).collect())
    got = before_in_run(running_sum(df, F.coalesce("v", F.lit(0)), "s", block=50), "v", "p", block=30)
    assert sorted((r.run_id or "", r.n, r.s, r.p) for r in got.collect()) == want
