"""Joins on ranges and on containment against plain loops."""

import random

import pytest

from loomwatch.operators import containment, ranges, score


def test_range_join_equals_plain(spark):
    rnd = random.Random(1)
    points = [("a" if rnd.random() < 0.8 else "b", rnd.choice([None, *range(-50, 400)]), k) for k in range(300)]
    spans = []
    for k in range(80):
        lo = rnd.randint(-60, 400)
        spans.append((rnd.choice("abc"), lo, lo + rnd.choice([0, 0, 1, 2, 3, 7, 8, 9, 60, 300, -1]), k))
    spans += [("a", None, 3, 90), ("a", 3, None, 91), (None, 0, 400, 92), ("a", 5, 5, 93), ("a", -(1 << 40), 1 << 40, 94)]
    p = spark.createDataFrame(points, "run string, n long, p int")
    r = spark.createDataFrame(spans, "run string, lo long, hi long, r int")
    got = sorted((x.p, x.r) for x in ranges.range_join(p, r, ["run"], "n", "lo", "hi").collect())
    want = sorted((c, f) for a, b, c in points for d, lo, hi, f in spans if a == d and None not in (b, lo, hi) and lo <= b <= hi)
    assert got == want and len(want) > 300
    assert ranges.range_join(p, r.filter("false"), ["run"], "n", "lo", "hi").count() == 0


@pytest.mark.parametrize("bits", [8, 17])
def test_range_totals_equal_counted_join(spark, bits):
    rnd = random.Random(3)
    points = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(-50, 400)])) for _ in range(300)]
    spans = [(rnd.choice("abc"), lo := rnd.randint(-60, 400), lo + rnd.choice([0, 0, 1, 7, 60, 300, -1]), k) for k in range(120)]
    spans += [("a", None, 3, 190), ("a", 3, None, 191), (None, 0, 400, 192), ("a", -(1 << 40), 1 << 40, 194)]
    p, r = spark.createDataFrame(points, "run string, n int"), spark.createDataFrame(spans, "run string, lo long, hi long, r int")
    d = ranges.range_totals(p, r, ["run"], "n", "lo", "hi", bits)
    want = {}
    for run, lo, hi, k in spans:
        inside = [n for g, n in points if g == run and None not in (g, n, lo, hi) and lo <= n <= hi]
        if inside:
            want[k] = (len(inside), min(inside), max(inside))
    assert {x.r: (x.records, x["first"], x["last"]) for x in d.collect()} == want and len(want) > 30
    assert ranges.range_totals(p, r.filter("false"), ["run"], "n", "lo", "hi").count() == 0


def test_range_totals_meet_no_pairs(spark):
    """A hundred thousand ranges that hold a hundred thousand points each: ten thousand million pairs."""
    p = spark.range(100_000).selectExpr("'r' as run", "id as n")
    r = spark.range(100_000).selectExpr("'r' as run", "-id as lo", "id + 100000 as hi", "id as f")
    d = ranges.range_totals(p, r, ["run"], "n", "lo", "hi")
    assert d.filter("records = 100000 and first = 0 and last = 99999").count() == 100_000


def test_range_join_meets_no_run_in_one_key(spark):
    """The equi-join is on bins: a point of a long run has as many rows as there are levels, a range two."""
    p = spark.range(20_000).selectExpr("'r' as run", "id as n")
    r = spark.range(2_000).selectExpr("'r' as run", "id * 10 as lo", "id * 10 + 5 as hi", "id as f")
    d = ranges.range_join(p, r, ["run"], "n", "lo", "hi")
    assert d.count() == 2_000 * 6
    assert "CartesianProduct" not in d._jdf.queryExecution().toString() and "NestedLoop" not in d._jdf.queryExecution().toString()


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contained_equals_plain(spark, sent):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcé.") for _ in range(n))
    lits = [word(rnd.randint(1, 9)) for _ in range(60)] + ["", None, "aaaa", "aaaaaaa", "abc" * 40, "h1.net", "h11.net"]
    texts = [word(rnd.randint(0, 60)) for _ in range(80)] + [None, "", "a" * 50, "x" + "abc" * 41, "h11.net", "zz h1.net'"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    w = spark.createDataFrame([(x,) for x in lits] * 2, "lit string")
    got = sorted((r.id, r.lit) for r in containment.contained(t, w, "id", "text", "lit", sent).collect())
    want = sorted((k, x) for k, s in enumerate(texts) for x in {y for y in lits if y} if s and x in s)
    assert got == want and len(want) > 200
    assert containment.contained(t, w.filter("false"), "id", "text", "lit", sent).count() == 0
    assert containment.contained(t.filter("false"), w, "id", "text", "lit", sent).count() == 0


def test_long_text_in_parts(spark):
    text = "q" * ((1 << 20) - 3) + "needle!" + "q" * 50
    t = spark.createDataFrame([(1, text)], "id long, text string")
    w = spark.createDataFrame([("needle!",), ("needle?",)], "lit string")
    assert [tuple(r) for r in containment.contained(t, w, "id", "text", "lit", 0).collect()] == [(1, "needle!")]


def test_literals_that_begin_alike_do_not_meet_in_one_key(spark):
    """Substrings leave a task only where a whole literal may stand, though all literals and all texts share their first bytes."""
    n = 20_000
    w = spark.range(n).selectExpr("concat('<order line ', id, '>') as lit")
    t = spark.range(2 * n).selectExpr("id", "concat('seen: <order line ', id, '> and more') as text")
    d = containment.contained(t, w, "id", "text", "lit", 0)
    assert d.filter("lit = concat('<order line ', id, '>')").count() == n == d.count()
    left = containment._by_hash(t, "id", "text", w.withColumnRenamed("lit", "_lit"))._jdf.queryExecution().analyzed().toString()
    assert "_bytes" in left and "_gram" not in left


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contained_rows_equal_plain_join(spark, sent):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    rows = [(word(rnd.randint(0, 9)), k) for k in range(150)] + [(None, 900), ("", 901)]
    texts = [word(rnd.randint(0, 50)) for _ in range(60)] + [None, ""]
    t = spark.createDataFrame([((k % 2, k), x) for k, x in enumerate(texts)], "f struct<run:long,id:long>, text string").repartition(3)
    d = containment.contained_rows(t, spark.createDataFrame(rows, "raw string, line long"), "f", "text", "raw", sent)
    want = {(k, line) for k, x in enumerate(texts) for raw, line in rows if raw and x and raw in x}
    assert {(r.f.id, r.line) for r in d.collect()} == want and len(want) > 100


def test_hits_are_worked_out_once_for_misses(spark):
    """Lines of two runs; a quote counts only in its own run, and both kinds of misses take one search of the evidence."""
    f = spark.createDataFrame([("r", "a", 1, 5, 6, "x <l 3> y"), ("r", "a", 2, 50, 60, "nothing"), ("s", "b", 3, 50, 60, "x <l 3> y"), ("s", None, 4, 50, 60, None)], "run string, format string, finding long, lo long, hi long, evidence string")
    lab = spark.createDataFrame([("r", "a", 3, " <l 3>"), ("r", "a", 6, "<l 6>"), ("r", "b", 7, " "), ("s", "b", 8, None)], "run string, format string, line long, raw string")
    hits = score.cited_hits(f, lab, ["run"])
    assert sorted(tuple(r) for r in hits.collect()) == [("r", 1, 3), ("r", 1, 6)]
    d = score.misses(f, hits, lab, "format", 3)
    got = {(r.format, r.kind, r.n) for r in d.collect()}
    assert {("b", "miss", 2), (None, "miss", 2), ("a", "false positive", 1), ("b", "false positive", 1)} <= got and sum(r[2] for r in got) == 2 * 2 + 3 * 2
    run = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert run.count("MapInArrow") == 1 and "ReusedExchange" in run


def test_literals_of_one_shape_meet_texts_by_their_words(spark):
    """Many literals of few counts of words need neither a filter nor Python; equal to a plain search, also at both ends of a text and across its parts."""
    rnd = random.Random(9)
    lits = [f"<line {k}>" for k in range(40)] + [f"é {k}-x y {k}" for k in range(40)] + ["_ a_1 é"]
    pad = lambda: rnd.choice(["", "z", "é", " ", "ab ", " 1 <", "\n"])
    texts = [pad() + "".join(pad() + rnd.choice(lits) for _ in range(rnd.randint(0, 5))) + pad() for _ in range(120)] + [None, "", " ", "<line 1", "x" * 300]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    w = spark.createDataFrame([(x, k) for k, x in enumerate([*lits, *lits[:5], "", None])], "lit string, line long")
    part, containment.PART_CHARS = containment.PART_CHARS, 16
    try:
        d = containment.contained_rows(t, w, "id", "text", "lit", 0)
        got = {(r.id, r.line) for r in d.collect()}
        once = containment.contained(t, w, "id", "text", "lit", 0)
        pairs = sorted(tuple(r) for r in once.collect())
    finally:
        containment.PART_CHARS = part
    want = {(k, n) for k, s in enumerate(texts) for n, x in enumerate([*lits, *lits[:5]]) if s and x in s}
    assert got == want and len(want) > 200
    assert pairs == sorted({(k, x) for k, s in enumerate(texts) for x in lits if s and x in s})
    for x in (d, once):
        assert "MapInArrow" not in x._jdf.queryExecution().analyzed().toString()


def test_literals_that_share_their_words_are_not_met_by_them(spark):
    """Literals that differ only in what stands before and behind the words that they share would all meet in one key."""
    w = spark.range(1500).selectExpr("concat(lpad(cast(id as string), 4, '0'), ' a b') as _lit")
    assert containment._plan(w, 0)[:2] == (False, None) and containment._plan(w, 1 << 20)[0]
    w = spark.range(1500).selectExpr("concat('x ', id, ' a b') as _lit")
    assert containment._plan(w.union(w), 0)[:2] == (False, [2])
