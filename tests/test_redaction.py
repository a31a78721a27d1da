"""Redaction: kinds stay apart, names are masked whole, large scopes cost what their marks cost."""

import re

from loomwatch.operators import redact

ROWS = "scope string, n long, text string, mark string, token string, key string"


def rows(spark, texts, scope="s"):
    return spark.createDataFrame([(scope, k, t, "m", "t", "k") for k, t in enumerate(texts)], ROWS).repartition(3)


def run(df, **kw):
    return [r.redacted for r in sorted(redact.redact(df, "scope", "n", "text", **kw).collect(), key=lambda r: r.n)]


def test_address_in_a_names_place(spark):
    line = "Failed password for invalid user 10.0.0.1 from 10.0.0.2 port 22 user=10.0.0.1"
    # the address is masked first; what is left in the name's place of the first pattern is the word before it
    assert run(rows(spark, [line])) == ["Failed password for [USER-1] user [IP-1] from [IP-2] port 22 user=[IP-1]"]


def test_every_kind_and_order(spark):
    texts = [
        "user=bob at 1.2.3.4", "auth failed for user 'al ice' from 5.6.7.8", "login for 'bob' from fe80:1:2:3:4:5:6:7", "Accepted publickey for eve from 1.2.3.4", "session for user eve",
        None, "", "bob 1.2.3.4", "\x01U\x02 bell\x07 1.2.3.4", "user=bob at 1.2.3.4",
    ]
    assert run(rows(spark, texts)) == [
        "user=[USER-1] at [IP-1]", "auth failed for user '[USER-2]' from [IP-2]", "login for '[USER-1]' from [IP-3]", "Accepted publickey for [USER-3] from [IP-1]", "session for user [USER-3]",
        None, "", "bob [IP-1]", "U bell [IP-1]", "user=[USER-1] at [IP-1]",
    ]


def test_known_names(spark):
    known = spark.createDataFrame([("s", "HOST", "app-01"), ("s", "HOST", "app-01.internal"), ("s", "USER", "bob"), (None, "HOST", "gw"), ("t", "HOST", "port"), ("s", "HOST", "—"), ("s", "HOST", "bob")], "scope string, kind string, value string")
    texts = ["app-01.internal app-01 xapp-01 app-01x bob bobby gw port", "gw user=bob 10.0.0.1"]
    want = ["[HOST-1] [HOST-2] xapp-01 app-01x [USER-1] bobby [HOST-3] port", "[HOST-3] user=[USER-1] [IP-1]"]
    assert run(rows(spark, texts), known=known) == want
    assert run(rows(spark, texts), known=known.filter("scope is not null"), sent=0) == [w.replace("[HOST-3]", "gw") for w in want]


def test_large_scope_and_null_scope(spark):
    n = 100_000
    df = spark.range(n).selectExpr("'s' as scope", "id as n", "concat('from 10.', id div 65536, '.', (id div 256) % 256, '.', id % 256) as text")
    got = redact.redact(df, "scope", "n", "text")
    assert got.filter("redacted <> concat('from [IP-', n + 1, ']')").count() == 0 and got.count() == n
    empty = rows(spark, ["1.1.1.1"], None)
    assert run(empty) == ["[IP-1]"]
    assert run(rows(spark, ["x"]).filter("false")) == []


def test_marks_follow_the_patterns(spark):
    """What is marked is what the name patterns find, one after the other."""
    from loomwatch.functions import patterns as P

    text = "Failed none for invalid user x.y$ for user zed user=q_1, for 'a b' invalid user w"
    got = {(r.kind, r.value) for r in redact.token_table(rows(spark, [text]), "scope", "n", "text").collect()}
    want = {("USER", m.group(1)) for rx in P.USER_NAMES for m in re.finditer(rx, text)}
    assert got == want


def test_names_are_not_looked_for_inside_marks(spark):
    """What one pattern has marked is text to no later one; a cue that control characters part is found."""
    texts = ["log for 'a user=bob' user=bob", "us\x01er=eve", "user 'invalid user x' invalid user x", "from 1.2.\x033.4", "no cue"]
    want = ["log for '[USER-1]' user=[USER-2]", "user=[USER-3]", "user '[USER-4]' invalid user [USER-5]", "from [IP-1]", "no cue"]
    assert run(rows(spark, texts)) == want
    got = {(r.value, r.token) for r in redact.token_table(rows(spark, texts), "scope", "n", "text").collect()}
    assert got == {("a user=bob", "[USER-1]"), ("bob", "[USER-2]"), ("eve", "[USER-3]"), ("invalid user x", "[USER-4]"), ("x", "[USER-5]"), ("1.2.3.4", "[IP-1]")}


def test_texts_are_marked_once(spark):
    """Numbering and putting together read what was marked; neither goes over the texts again."""
    d = rows(spark, ["user=bob from 1.2.3.4", "user=bob from 1.2.3.4", "user=eve"])
    known = spark.createDataFrame([("s", "HOST", "from")], "scope string, kind string, value string")
    for table in (redact.token_table(d, "scope", "n", "text"), redact.token_table(d, "scope", "n", "text", known=known)):
        assert table.count() == (3 if "HOST" not in {r.kind for r in table.collect()} else 4)
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "MapInArrow" not in plan
    plan = redact.redact(d, "scope", "n", "text", known=known)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "invalid user" not in plan


def test_many_known_names_in_one_text(spark):
    """A text is put together once, not once a name that stands in it; a place is looked up, not held against all that are taken."""
    known = spark.createDataFrame([("s", "HOST", "app-01"), ("s", "USER", "app")], "scope string, kind string, value string")
    words = "app-01 from 1.2.3.4 "
    want = "[USER-1]-01 from [IP-1] "
    assert run(rows(spark, [words * 30_000]), known=known) == [want * 30_000]


def test_distinct_texts_are_hashed_and_names_fetched_once(spark):
    rows = spark.createDataFrame([("a", 3, "x y\x00"), ("a", 1, "x y"), ("b", 2, "x y"), (None, 5, "x y"), ("a", 4, None)], "s string, n long, t string")
    d = redact._distinct(rows, "s", "n", "t", None)
    assert sorted((r.scope or "", r.first, r._t) for r in d.collect()) == [("", 5, "x y"), ("a", 1, "x y"), ("b", 2, "x y")]
    assert "SortAggregate" not in d._jdf.queryExecution().executedPlan().toString()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    known = spark.createDataFrame([("a", "USER", "x"), ("b", "HOST", "y")], "scope string, kind string, value string").mapInArrow(counted, "scope string, kind string, value string")
    got = redact._with_known(d.withColumnRenamed("_t", "mark").select("scope", "key", "first", "mark"), known, 2)
    assert seen.value == 2
    assert sorted((r.scope or "", r.mark) for r in got.collect()) == [("", "x y"), ("a", "\x01Ux\x02 y"), ("b", "x \x01Hy\x02")]
