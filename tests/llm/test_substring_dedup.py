import hashlib
import random
from collections import Counter

from loomwatch.llm import substring_dedup as sd


def brute(docs, length):
    seen = Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for d, t in docs:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(rng, n, alphabet, passages):
    docs = []
    for k in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 2)
                t += p[a : a + rng.randint(10, len(p))]
            else:
                t += "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        docs.append((k, t))
    for k in range(n, n + 6):
        docs.append((k, rng.choice(docs)[1]))
    return docs


def check(spark, docs, length, gram):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute([(d, (t or "").encode()) for d, t in docs], length)
    for hot in (65_536, 3, 1):  # all grams in one task each; the frequent ones as ranges; every gram as ranges
        got = sorted(tuple(r) for r in sd.substring_dedup(df, length, gram, hot=hot).collect())
        assert got == want, hot


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (50, 90, 150)]
    check(spark, corpus(rng, 60, "abcdé ", passages), 40, 8)


def test_periodic_texts_and_repeated_rows(spark):
    rng = random.Random(6)
    docs = corpus(rng, 20, "ab", ["ab" * 40, "a" * 70, "abc" * 30])
    docs += [docs[3], docs[3], (100, "a" * 300), (101, ""), (102, None), (103, "x" * 39), (104, "y" * 40)]
    check(spark, docs, 40, 8)


def test_numbered_rows_of_any_count(spark):
    assert sd.bucket_count(10**10, 8) <= 100_000 and sd.bucket_count(40_000, 2) == 3
    before = spark.catalog.listTables()
    rows = sd.numbered(spark.createDataFrame([(k, "t") for k in range(50)], "a long, text string"), "row")
    assert spark.catalog.listTables() == before
    assert sorted(r.a for r in rows.join(rows.select("row"), "row").collect()) == list(range(50))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, row string, a int")
    assert sd.substring_dedup(df).collect() == []


def test_loser_tree_never_breaks_order():
    rng = random.Random(1)
    rows = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))), b"", (k, 0, 0, 0, 0)) for k in range(300)]
    for runs in (1, 2, 3, 7):
        split = [sorted(rows[k::runs]) for k in range(runs)]
        got = list(sd.merge([sd.Run(sd.front_code(s)) for s in split]))
        assert [(k, t, i) for _, k, t, i in got] == sorted(rows)
        for (_, x, _, _), (h, y, _, _) in zip(got, got[1:]):
            assert h == sd.common_prefix(x, y)


def test_cut_repeats_keeps_columns_and_characters(spark):
    rng = random.Random(11)
    docs = corpus(rng, 30, "abcdé ", ["".join(rng.choice("abcdé ") for _ in range(90))])
    rows = [(k, t, len(t), "s") for k, t in docs] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string").repartition(3)
    got = {r.doc_id: r for r in sd.cut_repeats(df, 40, 8).collect()}
    want = {r.doc_id: r for r in sd.substring_dedup(df, 40, 8, with_text=True).collect()}
    assert len(got) == len(rows) and got[99].text is None
    for k, t, n, s in rows[:-1]:
        assert (got[k].text, got[k].n_chars, got[k].source) == (want[k].kept, len(want[k].kept), s)
    assert sum(r.n_removed for r in want.values()) > 500


def test_passages_of_words_are_counted(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage, line = words(60), words(30)
    docs = [(0, words(80) + " " + passage + " " + words(40)), (1, words(10) + " " + passage), (2, words(90) + " " + line), (3, line + " " + words(50)), (4, words(200))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in sd.substring_dedup(df, 400, passages=(128, 50)).collect()}
    assert [got[k].n_passages for k in range(5)] == [1, 1, 0, 0, 0]
    assert all(len(passage) <= got[k].passage_bytes <= len(passage) + 4 for k in (0, 1)) and got[4].passage_bytes == 0
