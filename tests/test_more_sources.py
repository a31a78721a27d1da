from datetime import datetime

from pyspark.sql import functions as F

from loomwatch.operators import intel, redact, rollups, score, sigma
from loomwatch.sources import envelopes as E, lines as L, structured as S
from loomwatch.streaming import live
from tests_support import lines_of


def test_forwarded_syslog(spark):
    text = [
        "|30|Aug 17 09:37:02 web app[12]: 2026-08-17 09:37:02,481: DEBUG helpers.updater ok", "|27|Aug 17 09:37:03 web app[12]: no date here",
        "|999|Aug 17 09:37:04 web plain", "Aug 17 09:37:04 web plain",
    ]
    r = E.forwarded(lines_of(spark, text), 2025).orderBy("n").collect()
    assert [(x.level, x.ts) for x in r] == [("DEBUG", datetime(2026, 8, 17, 9, 37, 2)), ("ERROR", datetime(2025, 8, 17, 9, 37, 3)), ("UNKNOWN", datetime(2025, 8, 17, 9, 37, 4))]
    assert L.sniff(lines_of(spark, text)).first().format == "forwarded"


def test_datagrams_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("<34>1 2024-01-01T00:00:00Z web app 1 ID - hello\n<13>Feb  5 17:32:18 db su: bad\nbare\n")
    s = live.tail(spark, str(tmp_path / "in")).select(E.datagram(F.col("raw"), F.lit("10.0.0.9")).alias("d")).select("d.*")
    live.run_to_end(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.facility, r.severity, r.host, r.host_given, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("auth", "CRITICAL", "web", True, "hello"), ("user", "NOTICE", "db", True, "su: bad"), (None, None, "10.0.0.9", False, "bare")}


def test_sigma_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Failed password\nfine\n")
    rule = {"id": "x", "level": "high", "detection": {"s": {"msg|contains": "failed password"}, "condition": "s"}}
    s = live.tail(spark, str(tmp_path / "in")).withColumn("n", F.lit(1).cast("long"))
    live.run_to_end(sigma.hits(s, [rule], {"msg": F.col("raw")}), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Failed password"]


def test_universal_formats(spark):
    heads = {
        "a.log": '{"a":1}\n{"b":2}\n', "b.log": "[1]", "c.log": "<Events><Event/></Events>", "d.log": "<!DOCTYPE html><html>", "e.log": "a,b,c\n1,2,3\n", "f.log": "plain words here",
        "g.csv": "x", "h.log": " ", "i.log": "9/1/2024 8:05:02 AM\nEventCode=4625\n", "j.log": "<log><x/></log>",
    }
    got = {r.run_id: r.format for r in L.universal_format(spark.createDataFrame(list(heads.items()), "run_id string, head string")).collect()}
    assert got == {"a.log": "jsonl", "b.log": "json", "c.log": "evtx_xml", "d.log": "html", "e.log": "csv", "f.log": "text", "g.csv": "csv", "h.log": "empty", "i.log": "windows_text", "j.log": "xml"}


def test_vendor_payloads(spark, tmp_path):
    d = spark.createDataFrame([(1, '{"data": [{"b": 1, "a": 2}, {"c": 3}]}'), (2, '{"z": 1, "y": 2}')], "k int, json string")
    assert sorted(r.raw for r in S.vendor_events(d).collect()) == ['{"a":"2","b":"1"}', '{"c":"3"}', '{"y":"2","z":"1"}']
    s = S.splunk_export(lines_of(spark, ['{"preview": false, "result": {"host": "h"}}', '{"host": "g"}'])).orderBy("n").collect()
    assert [r.fields["host"] for r in s] == ["h", "g"]
    (tmp_path / "p.xml").write_text("<log><entry><src>10.0.0.1</src><action>deny</action></entry></log>")
    assert S.xml_entries(spark, str(tmp_path / "p.xml"), "src string, action string").first().action == "deny"


def test_verdicts(spark):
    p = spark.createDataFrame([(7, None), (2, None), (0, None), (None, 60), (None, 10)], "pulses int, confidence int")
    assert [(r.score, r.verdict) for r in intel.provider_verdict(p).collect()] == [(70.0, "malicious"), (20.0, "suspicious"), (0.0, "clean"), (60.0, "malicious"), (10.0, "suspicious")]
    texts = ["State: NOT VULNERABLE CVE-2020-1", "VULNERABLE: true, risk moderate", "CVE-2020-1234 remote code execution", "open", None, "target is vulnerable"]
    got = [tuple(r.v) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(intel.nse_verdict(F.col("t")).alias("v")).collect()]
    assert got == [(False, "info"), (True, "medium"), (True, "critical"), (False, "info"), (False, "info"), (True, "high")]
    v = spark.createDataFrame([("1.2.3.4",), ("1.2.3",)], "value string")
    i = spark.createDataFrame([("i1", "[ipv4-addr:value = '1.2.3.4']")], "id string, pattern string")
    assert [tuple(r) for r in intel.inside_patterns(v, i).select("value", "indicator").orderBy("value").collect()] == [("1.2.3", "i1"), ("1.2.3.4", "i1")]  # inside is contained, not equal


def test_scorecards_and_inventories(spark):
    s = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 0, 0)], "rule_id string, hit int, expected int")
    assert {(r.rule_id, r.hit, r.recall) for r in score.merged_recall(s).collect()} == {("a", 3, 0.75), ("b", 0, None), (None, 3, 0.75)}
    lines = spark.createDataFrame([("x", "user 'bob' 10.0.0.1"), ("y", "10.0.0.1"), ("z", "user 'eve'")], "k string, t string")
    inv = score.inventory(lines, "t", "k")
    assert [r.value for r in score.shared_values(inv, "k", "x", "y").collect()] == ["10.0.0.1"] and score.shared_values(inv, "k", "x", "z").count() == 0
    m = score.severity_mismatch(spark.createDataFrame([("r", None, "HIGH"), ("q", "e", "LOW")], "rule string, entity string, severity string"), spark.createDataFrame([("r", None, "low"), ("q", "e", "low")], "rule string, entity string, severity string"))
    assert [(r.rule, r.found, r.expected) for r in m.collect()] == [("r", "HIGH", "low")]
    f = spark.createDataFrame([(1, 2), (2, 0)], "finding int, hits int")
    assert [r.finding for r in score.dropped_true(f, spark.createDataFrame([(1, False), (2, False)], "finding int, kept boolean")).collect()] == [1]
    h = spark.createDataFrame([("r", datetime(2024, 1, 1), "a", True, "rules"), ("r", datetime(2024, 1, 2), "b", False, "model")], "run_id string, ts timestamp, host string, host_derived boolean, source string")
    r = rollups.run_header(h).first()
    assert (r.hosts, r.model, r.rules) == (["a"], 1, 1)


def test_remap_is_one_pass(spark):
    d = spark.createDataFrame([("10.0.0.1 10.0.0.11 bob",), (None,)], "t string")
    got = [r.t for r in redact.remap(d, "t", {"10.0.0.1": "10.0.0.11", "10.0.0.11": "x", "bob": "eve"}).collect()]
    assert got == ["10.0.0.11 x eve", None]
