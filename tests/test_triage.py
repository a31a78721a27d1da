from pyspark.sql import functions as F

from loomwatch.operators import enrich, infra, triage

SCHEMA = (
    "id long, types array<string>, techniques array<string>, ips array<string>, users array<string>, hosts array<string>, ports array<string>,"
    "lines array<long>, step_us array<long>, occurrences long, criticality string, severity string, label string, note string"
)


def rows(spark, note="x"):
    out = []
    for k in range(120):
        bad = k % 3 == 0
        out.append((k, ["auth_bruteforce"] if bad else ["disk_pressure"], [], [f"10.0.0.{k}"] * (1 + bad), [], ["h"], [], [1, 2], [0, 60_000_000 if bad else 0], 9 if bad else 1, None, "HIGH" if bad else "LOW", "confirmed" if bad else "benign", note))
    return spark.createDataFrame(out, SCHEMA)


def test_features_ignore_what_they_must_not_read(spark):
    a, b = (triage.features(rows(spark, n)).select("id", *triage.vector_names()).orderBy("id").collect() for n in ("x", "y"))
    assert a == b
    r = a[0]
    assert (r.family_auth, r.family_other, r.f_ips, r.f_occurrences, r.f_span_s, r.f_per_minute, r.f_timed) == (1.0, 0.0, 1.0, 9.0, 60.0, 9.0, 1.0)


def test_model_beats_the_majority_and_is_deterministic(spark):
    d = triage.folds(triage.features(rows(spark)))
    got = []
    for _ in range(2):
        m = triage.fit(d.filter("fold > 0"), trees=10)
        p = m.transform(d.filter("fold = 0").withColumn("weight", F.lit(1.0)))
        got.append(sorted((r.id, r.opinion) for r in p.collect()))
    assert got[0] == got[1]
    s = triage.confusion_scores(p).first()
    assert s.accuracy > 0.9 and s.macro_f1 > 0.9
    assert triage.sensitivity(m, rows(spark)).filter("flips").count() == 0
    assert {r.severity: r.n for r in triage.agreement(p).collect()} == {"HIGH": 8, "LOW": 16}


def test_infrastructure_guards(spark):
    lines = [
        ("INFO", "interface up"), ("ERROR", "boom"), ("WARN", "Failed password for root from 10.0.0.1"), (None, "firewall config changed by x"),
        (None, "nothing here"), ("INFO", "certificate about to expire"),
    ]
    d = spark.createDataFrame([("r", k, lv, "h", m, m) for k, (lv, m) in enumerate(lines)], "run_id string, n long, level string, host string, msg string, raw string")
    assert sorted((r.seq, r.severity, r.type) for r in infra.infrastructure(d).collect()) == [
        (1, "high", "infra_unknown_high"), (3, "high", "infra_firewall_high"), (5, "low", "infra_unknown_low")
    ]


def test_split_around_an_entity_and_restated(spark):
    d = spark.createDataFrame([("from 10.0.0.1 now", "10.0.0.1"), ("none", "x")], "t string, e string")
    r = [tuple(x.a) for x in d.select(enrich.around(F.col("t"), F.col("e")).alias("a")).collect()]
    assert r == [("from ", "10.0.0.1", " now"), ("none", "", "")]
    model = spark.createDataFrame([("r", 1, ["10.0.0.1"]), ("r", 2, ["10.0.0.9"])], "run_id string, id int, markers array<string>")
    det = spark.createDataFrame([("r", ["10.0.0.1", ":4444"])], "run_id string, markers array<string>")
    assert [x.id for x in enrich.restated(model, det).collect()] == [2]
    page, total = enrich.findings_page(spark.createDataFrame([(1, "LOW", "a", "h"), (2, "HIGH", "b", "h")], "seq int, severity string, type string, host string"), limit=1)
    assert page.first().type == "b" and (total.first().total, total.first().truncated) == (2, True)


def test_cross_validation_and_importance(spark):
    d = triage.folds(triage.features(rows(spark)), k=3)
    p = triage.cross_validate(d, k=3, trees=5, depth=3)
    got = sorted((r.id, r.fold, r.opinion, r.label) for r in p.collect())
    assert [g[0] for g in got] == list(range(120))  # every row once
    scores = {r.fold: r for r in triage.fold_scores(p).collect()}
    for fold in range(3):
        mine = [(g[2], g[3]) for g in got if g[1] == fold]
        assert scores[fold].rows == len(mine) and scores[fold].accuracy == round(sum(a == b for a, b in mine) / len(mine), 4)
    s = {r.metric: r for r in triage.spread(triage.fold_scores(p)).collect()}
    assert s["accuracy"].min <= s["accuracy"].mean <= s["accuracy"].max
    m = triage.fit(d, trees=1, depth=1)
    i = {r.feature: r.drop for r in triage.importance(m, d, "id").collect()}
    assert set(i) == {None, *triage.vector_names()} and i[None] == 0
    assert sum(x > 0 for x in i.values()) <= 1  # a stump reads one feature
    again = {r.feature: r.drop for r in triage.importance(m, d.repartition(7), "id").collect()}
    assert i == again
