"""Counts of every prefix against the tokenizer applied to that prefix."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loomwatch.llm import common, token_counts as tc

PATH = common.vocabulary("word_bpe_49k.json")
OWN = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    c = tc.PrefixCounter(PATH)
    c.own = lambda text: pytest.fail(f"counted by the tokenizer: {text!r}")  # the method alone gives every count
    return c


def own(text):
    return len(OWN.encode(text, add_special_tokens=False).ids)


def check(counter, text):
    steps = next(counter.steps([text]))
    assert np.concatenate(([0], steps.cumsum(dtype=np.int64))).tolist() == [own(text[:k]) for k in range(len(text) + 1)], text


CASES = [
    "", "a", " ", " \n\t a  b ", "it's we're he'll 're 'x ''s !'s 'r 'rest don't", "<|endoftext|>", "abc<|endoftext|>def<|startoftext|>", "<|endoftext<|endoftext|>|>",
    "<|ENDOFTEXT|>", "é ééx́ ố", "각 각", "ΑΣ ΣΑΣ", "İstanbul", "a\xa0b c", "x\x1cy \x85z", "👍🏽👩‍👩‍👧 ok",
    "中文字符測試", "1234 5th", "http://www.x.y/z?a=1&b=2", "a" * 90, "̀start", "'ś", "'ré", "한" * 60, "é" * 80 + "!́",
]


@pytest.mark.parametrize("text", CASES)
def test_every_prefix(counter, text):
    check(counter, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeéñ'’!1 <|endoftext|>sretvḿ̧Σİß각가가中 \n\t")), max_size=40))
def test_random_texts(text):
    c = tc.counter(PATH)
    check(c, text)


def test_documents(spark, counter):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts[::10]:
        check(counter, t[:400])
    assert [int(s.sum(dtype=np.int64)) for s in counter.steps(texts)] == [len(e.ids) for e in OWN.encode_batch(texts, add_special_tokens=False)]


def test_tables_answer_budgets(spark):
    rnd = random.Random(5)
    long = " ".join(f"w{(k * 7919) % 100_003}" for k in range(60_000))
    texts = [None, "", "one two three", "the <|endoftext|> end", "".join(rnd.choice("ab 'é\n") for _ in range(300)), long, long]
    docs = spark.createDataFrame([(k if k else None, t, "x", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, counts string, n_tokens int, points int").repartition(3)
    got = {r.doc_id: r for r in tc.token_counts(docs, PATH, 50).collect()}
    assert len(got) == 7
    for k, t in enumerate(texts):
        r, t = got[k if k else None], t or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), own(t), own(t) > 50)
        if len(t) < 400:
            assert r.fit_points == max(i for i in range(len(t) + 1) if own(t[:i]) <= 50) and r.fit_tokens == own(t[: r.fit_points])
    tables = tc.prefix_tables(docs, PATH).cache()
    for budget in (-1, 0, 3, 1000):
        for r in tc.within_budget(tables, budget).collect():
            t = texts[r.doc_id or 0] or ""
            if budget < 0:
                assert (r.points, r.tokens) == (-1, None)
            elif len(t) < 400:
                assert r.points == max(i for i in range(len(t) + 1) if own(t[:i]) <= budget) and r.tokens == own(t[: r.points])
            else:
                assert r.tokens == own(t[: r.points]) <= budget < own(t[: r.points + 1])
    for r in tc.count_at(tables, "doc_id * 3").collect():
        if r.doc_id is not None and len(texts[r.doc_id]) < 400:
            assert r.tokens == own(texts[r.doc_id][: r.points])
    assert tc.token_counts(docs.filter("false"), PATH).collect() == []
    assert tc.within_budget(tables.filter("false"), 3).collect() == []
