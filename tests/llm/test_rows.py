"""Tables whose ids repeat or are null: one row of each group stays, and its text with it."""

from collections import Counter

from loomwatch.llm import exact_dedup, near_dup, quality, substring_dedup


def prose(k, n=150):
    return " ".join(f"w{(k * 7919 + j * j * 31 + j * k) % 4001}" for j in range(n))


def table(spark):
    near = prose(5).split()
    near[70] = "other"
    rows = [
        (1, prose(1)), (1, prose(1)),  # the same row twice
        (None, prose(2)), (None, prose(2)), (None, prose(2) + " "),  # null ids
        (3, prose(3)), (3, prose(4)),  # one id, two texts
        (None, prose(5)), (None, " ".join(near)),  # near copies without ids
        (6, prose(6)), (None, prose(6)),
        (7, None), (None, ""),
    ]
    return spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)


def test_one_row_of_each_group_stays(spark):
    docs = table(spark)
    exact = exact_dedup.keep_distinct(docs).cache()
    assert exact.columns == docs.columns
    assert Counter(r.doc_id for r in exact.collect()) == Counter([1, None, 3, 3, None, None, 6, 7])
    one = near_dup.keep_one(exact).cache()
    assert one.columns == docs.columns
    assert Counter(r.doc_id for r in one.collect()) == Counter([1, None, 3, 3, None, 6, 7])
    left = substring_dedup.cut_repeats(one).collect()
    assert sorted(len(r.text or "") for r in left) == sorted(len(r.text or "") for r in one.collect())  # nothing is cut
    assert {prose(1), prose(3), prose(4), prose(6)} <= {r.text for r in left}
    straight = near_dup.near_duplicates(docs.drop("_row")).collect()
    assert len(straight) == 13 and sum(r.kept for r in straight) == 6 + 2  # two texts without words
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == 8


def test_filter_judges_each_row(spark):
    good = [prose(k, 60).capitalize() + "." for k in range(120)]
    bad = [("$$$ !! " * 40) + str(k) for k in range(60)]
    rows = [(k, t) for k, t in enumerate([*good, *bad])]
    labels = spark.createDataFrame([(k, int(k < 120)) for k in range(180)], "doc_id long, quality int")
    extra = [(0, bad[0]), (None, bad[1]), (None, good[1]), (170, good[2])]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string").repartition(3)
    left = Counter(r.text for r in quality.keep_good(docs, labels).collect())
    assert not set(left) & set(bad)
    assert left == Counter([*good, good[1], good[2]])
