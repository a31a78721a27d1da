import json

from pyspark.sql import functions as F

from loomwatch.operators import incidents as I, intel, ledger, lifecycle, redact, retrieval, rollups, score, sigma


def test_sigma_conditions(spark):
    d = spark.createDataFrame([("event 4625 failed",), ("id 146250",), ("failed by admin",)], "msg string")
    rule = {"id": "x", "level": "high", "detection": {"sel": {"msg|contains": ["4625", "failed"]}, "flt": {"msg|endswith": "admin"}, "condition": "sel and not flt"}}
    assert [r.hit for r in d.select(sigma.compile_rule(rule, {"msg": F.col("msg")}).alias("hit")).collect()] == [True, False, False]


def test_sessions_and_rollup(spark):
    gap = I.GAP_US
    rows = [("r", "a", 0, 1, "HIGH"), ("r", "a", gap, 2, "LOW"), ("r", "a", 2 * gap + 1, 3, "LOW"), ("r", "a", None, 4, "INFO"), ("r", "a", 9 * gap, 5, "INFO")]
    d = spark.createDataFrame([(*r, str(r[3]), "t") for r in rows], "run_id string, entity string, us long, seq long, severity string, id string, type string")
    s = {r.seq: r.cluster for r in I.sessions(d).collect()}
    assert s == {1: 0, 2: 0, 4: 0, 3: 1, 5: 2}
    got = I.incidents(I.rolled_up(I.sessions(d))).collect()
    assert {(r.cluster, r.severity, r.findings) for r in got} == {(0, "HIGH", 3), (-1, "LOW", 2)}
    assert len({r.incident_id for r in got}) == 2


def test_lifecycle_rejects_and_reopens(spark):
    t = [(1, 1, "acknowledged", 10), (1, 2, "open", 11), (1, 3, "resolved", 12), (1, 4, "acknowledged", 13), (1, 5, "reopened", 14), (2, 1, "reopened", 1)]
    r = {x.incident: x for x in lifecycle.lifecycle(spark.createDataFrame(t, "incident int, seq int, to string, at long")).collect()}
    assert (r[1].state, r[1].accepted, r[1].rejected, r[1].acknowledged_at, r[1].resolved_at) == ("reopened", 4, 1, None, None)
    assert (r[2].state, r[2].rejected) == ("open", 1)


def test_merge_keeps_the_analysts_columns(spark):
    new = spark.createDataFrame([("a", "HIGH"), ("b", "LOW")], "incident_id string, severity string")
    old = spark.createDataFrame([("a", "LOW", "mine"), ("c", "LOW", "gone")], "incident_id string, severity string, note string")
    got = {(r.incident_id, r.severity, r.note) for r in I.merge_stored(new, old, ["note"]).collect()}
    assert got == {("a", "HIGH", "mine"), ("b", "LOW", None), ("c", "LOW", "gone")}


def test_intel(spark, tmp_path):
    bundle = {"objects": [
        {"type": "indicator", "id": "i1", "name": "n", "pattern": "[ipv4-addr:value = '203.0.113.9' OR domain-name:value = 'bad.example']", "indicator_types": ["malicious-activity"]},
        {"type": "relationship", "relationship_type": "indicates", "source_ref": "i1", "target_ref": "attack-pattern--1"},
        {"type": "attack-pattern", "id": "attack-pattern--1", "name": "P", "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}], "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "initial-access"}]},
        {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Q", "revoked": True},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    o = intel.stix_objects(spark, str(tmp_path / "b.json"))
    assert {(r.ioc_type, r.value) for r in intel.stix_iocs(o).collect()} == {("ipv4", "203.0.113.9"), ("domain", "bad.example")}
    assert [(r.indicator, r.techniques) for r in intel.stix_links(o).collect()] == [("i1", ["attack-pattern--1"])]
    assert [(r.technique_id, r.phases) for r in intel.techniques(o).collect()] == [("T1", ["Initial Access"])]
    seen = intel.observed(spark.createDataFrame([(1, "from 203.0.113.9 to Bad.Example " + "a" * 64)], "n int, t string"), "t", ["n"])
    assert {(r.ioc_type, r.value) for r in seen.collect()} == {("ipv4", "203.0.113.9"), ("domain", "bad.example"), ("sha256", "a" * 64)}
    assert intel.match(seen, intel.stix_iocs(o)).count() == 2
    v = intel.vulnerabilities(spark.createDataFrame([("10.0.0.1", "CVE-2020-1234 9.8 and CVE-2021-9999")], "ip string, output string"))
    assert {(r.cve, r.cvss, r.band) for r in v.collect()} == {("CVE-2020-1234", 9.8, "CRITICAL"), ("CVE-2021-9999", None, "INFO")}
    m = spark.createDataFrame([("CRITICAL", ["benign"], []), ("LOW", ["malicious-activity"], ["t"])], "severity string, indicator_types array<string>, techniques array<string>")
    assert [r.severity for r in intel.feed_ceiling(m).collect()] == ["LOW", "LOW"]


def test_chain_breaks(spark):
    cols = ["seq", "what", "prev_hash"]
    rows, prev = [], None
    import hashlib

    for k in range(5):
        body = json.dumps({"seq": k, "what": f"w{k}", "prev_hash": prev}, sort_keys=True, separators=(",", ":"))
        h = hashlib.sha256(body.encode()).hexdigest()
        rows.append(("L", k, f"w{k}", prev, h))
        prev = h
    schema = "ledger string, seq long, what string, prev_hash string, entry_hash string"
    check = lambda r: ledger.verify_chain(spark.createDataFrame(r, schema), "ledger", "seq", "prev_hash", "entry_hash", F.sha2(ledger.canonical_json(cols), 256)).first()
    assert check(rows).ok
    bad = check([*rows[:2], ("L", 2, "forged", *rows[2][3:]), *rows[3:]])
    assert (bad.ok, bad.first_break, bad.reason) == (False, 2, "hash mismatch")
    gone = check([*rows[:2], *rows[3:]])
    assert (gone.first_break, gone.reason) == (3, "broken link")


def test_redaction(spark):
    d = spark.createDataFrame([("s", 1, "user=bob from 10.0.0.1 and 10.0.0.11"), ("s", 2, "10.0.0.11 again\x01, user=bob"), ("t", 1, "10.0.0.11"), ("t", 2, None)], "scope string, o int, t string")
    got = {(r.scope, r.o): r.redacted for r in redact.redact(d, "scope", "o", "t").collect()}
    assert got[("s", 1)] == "user=[USER-1] from [IP-1] and [IP-2]" and got[("s", 2)] == "[IP-2] again, user=[USER-1]"
    assert got[("t", 1)] == "[IP-1]" and got[("t", 2)] is None


def test_scores_are_null_without_a_base(spark):
    e = spark.createDataFrame([], "k int")
    s = score.set_score(e, spark.createDataFrame([(1,)], "k int"), ["k"]).first()
    assert (s.precision, s.recall, s.f1) == (None, 0.0, None)
    assert rollups.mean_gap(spark.createDataFrame([(5, 3)], "a int, b int"), F.col("a"), F.col("b")).first().mean is None


def test_bm25_prefers_the_rare_term(spark):
    d = spark.createDataFrame([(1, "ssh brute force ssh"), (2, "disk full disk"), (3, "brute disk")], "id int, t string")
    q = spark.createDataFrame([(9, "ssh brute")], "id int, t string")
    r = retrieval.bm25(retrieval.terms(d, "id", "t"), retrieval.words(q, "id", "t")).orderBy(F.desc("score")).collect()
    assert [x.doc for x in r] == [1, 3] and r[0].coverage == 1.0
    t = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "b", "y"), (3, "a", "x")], "id int, dim string, value string")
    assert [(r.other, r.overlap) for r in retrieval.precedents(t).filter("id = 1").orderBy("rank").collect()] == [(3, 2), (2, 1)]


def test_alignment_takes_the_most_severe(spark):
    r = [(1, "HIGH", ["a"], "h", [5]), (2, "low", [], "h", []), (3, "CRITICAL", ["z"], None, None), (4, "HIGH", [], "h", [9]), (5, "MEDIUM", ["a"], None, None)]
    m = [(10, "MEDIUM", ["a"], ["h"], []), (11, "CRITICAL", [], ["x"], [5]), (12, "HIGH", [], ["h"], [7]), (13, "MEDIUM", ["a"], None, None)]
    rules = spark.createDataFrame(r, "id int, severity string, ips array<string>, host string, lines array<long>")
    model = spark.createDataFrame(m, "id int, severity string, ips array<string>, hosts array<string>, lines array<long>")
    got = {x.id: tuple(x)[1:] for x in score.align(rules, model).collect()}
    assert got == {1: (11, "CRITICAL", "over-rated"), 2: (12, "HIGH", "over-rated"), 3: (None, "MISSED", "under-rated"), 4: (10, "MEDIUM", "under-rated"), 5: (10, "MEDIUM", "agree")}
    assert {x.id: x.delta for x in score.align(rules, model.filter("false"), covered=False).collect()} == dict.fromkeys(range(1, 6), "unknown")


def test_citations_by_range_and_verbatim(spark):
    f = spark.createDataFrame([("r", "k", 1, 3, 5, None), ("r", "k", 2, None, None, "saw <bad line> twice"), ("q", "j", 3, 9, 8, "x")], "rule_id string, format string, finding int, lo long, hi long, evidence string")
    lab = spark.createDataFrame([("k", 4, "four"), ("k", 8, " <bad line>\n"), ("j", 9, "  "), ("j", 10, "x y")], "format string, line long, raw string")
    hits = score.cited_hits(f, lab)
    assert sorted(tuple(r) for r in hits.collect()) == [(1, 4), (2, 8)]
    card = {r.rule_id: (r.findings, r.true_findings, r.lines_hit, r.labelled, r.precision, r.recall) for r in score.scorecard(f, hits, lab).collect()}
    assert card == {"r": (2, 2, 2, 4, 1.0, 0.5), "q": (1, 0, 0, 4, 0.0, 0.0), None: (3, 2, 2, 4, 0.6667, 0.5)}
    lost = sorted((r.format or "", r.kind, r.n, r.samples) for r in score.misses(f, hits, lab, "format", 1).collect())
    assert lost == [("", "false positive", 1, ["x"]), ("", "miss", 2, ["  "]), ("j", "false positive", 1, ["x"]), ("j", "miss", 2, ["  "])]


def test_precedents_by_sets_equal_all_pairs(spark):
    import random

    rnd = random.Random(8)
    rows = [(k, d, "hot" if rnd.random() < 0.5 else str(rnd.randint(0, 9))) for k in range(200) for d in "abc"] + [(k, "a", "second") for k in range(0, 200, 3)] + [(5, "b", None)]
    t = spark.createDataFrame(rows, "id long, dim string, value string")
    few, all_ = (sorted(map(tuple, retrieval.precedents(t, limit=4, few=n).collect())) for n in (6, 0))
    assert few == all_ and len(few) == 800
    assert retrieval.precedents(t.filter("false")).collect() == []


def test_best_by_bound_equals_best_of_all(spark):
    import random

    rnd = random.Random(9)
    word = lambda: "w" + str(min(rnd.randint(0, 60), rnd.randint(0, 60), rnd.randint(0, 60)))
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(rnd.randint(0, 40)))) for k in range(150)], "id long, t string")
    q = spark.createDataFrame([(k, " ".join(word() for _ in range(rnd.randint(1, 8)))) for k in range(40)] + [(99, "nowhere"), (98, "w0 w0 w1")], "id long, t string")
    d, w = retrieval.terms(docs, "id", "t"), retrieval.words(q, "id", "t")
    for probe in (0, 5, 10_000):
        a, b = ({r.query: (r.doc, round(r.score, 9), r.coverage) for r in retrieval.cite(f, 0.0, 0.0).collect()} for f in (retrieval.bm25(d, w), retrieval.bm25_best(d, w, probe)))
        assert a == b and len(a) >= 40


def test_best_by_one_scan_equals_best_of_all(spark):
    import random

    rnd = random.Random(11)
    word = lambda: rnd.choice(["w", "W", "\u212a", "\u0130x", "é", "longwordoverthesixteen", "abcdefgh"]) + str(min(rnd.randint(0, 30), rnd.randint(0, 30)))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    docs = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), *((k + 500, t) for k, t in enumerate(texts[:40])), (900, None), (901, "w1, " * 400_000)], "id long, t string").repartition(3)
    q = spark.createDataFrame([(k, " ".join(word() for _ in range(rnd.randint(1, 8)))) for k in range(40)] + [(99, "nowhere"), (98, "w0 w0 w1")], "id long, t string")
    w = retrieval.words(q, "id", "t")
    a, b, c = ({r.query: (r.doc, round(r.score, 9), r.coverage) for r in retrieval.cite(f, 0.0, 0.0).collect()} for f in (
        retrieval.bm25(retrieval.terms(docs, "id", "t"), w), retrieval.best_documents(docs, "id", "t", w), retrieval.best_documents(docs, "id", "t", w, 0)))
    assert a == b == c and len(a) >= 40
    plan = retrieval.best_documents(docs, "id", "t", w)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert retrieval.best_documents(docs.filter("false"), "id", "t", w).count() == 0 == retrieval.best_documents(docs, "id", "t", w.filter("false")).count()


def test_passage_is_the_best_paragraph(spark):
    docs = spark.createDataFrame([(1, "# Title\n\nfirst about nothing\n\n alpha beta \n\nbeta alpha gamma\n\nalpha beta gamma")], "id long, t string")
    cited, q = spark.createDataFrame([(7, 1)], "query long, doc long"), spark.createDataFrame([(7, "alpha"), (7, "gamma"), (7, "alpha")], "id long, term string")
    assert retrieval.passages(cited, docs, q, "t").first().passage == "beta alpha gamma"


def test_canonical_text_at_every_depth(spark):
    import json

    from loomwatch.operators import ledger

    cases = ['{"b": 1.0, "a": {"z": [{"d": 1, "c": null}], "é": "x\\u00e9\\n"}, "B": 1e5}', '[{"b":-0.0,"a":12345678901234567890}]', '{"a":1,"a":2}', "bad{", "", None]
    d = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, t string").select("k", ledger.canonical_text(F.col("t")).alias("c"))
    got = [r.c for r in d.orderBy("k").collect()]
    assert got[0] == json.dumps(json.loads(cases[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[1:] == ['[{"a":12345678901234567890,"b":-0.0}]', '{"a":2}', None, None, None]
