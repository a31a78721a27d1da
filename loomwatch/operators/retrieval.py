"""Precedents by shared tokens and BM25 over a document table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwatch.functions import patterns as P


#: Tokens of an item up to which its sets of tokens are looked up (2^n - 1 of them) instead of every item that shares one.
FEW_TOKENS = 6


def precedents(tokens: DataFrame, queries: DataFrame | None = None, limit: int = 10, few: int = FEW_TOKENS) -> DataFrame:
    """(id, other, overlap, dimensions, rank): items that share at least one (dim, value) token, best first, at most ``limit``: by shared tokens, shared
    dimensions, then id.

    In: (id, dim, value); null values are no tokens. ``queries`` (id) bounds the left side. Items of at most ``few`` tokens are looked up by their sets of tokens:
    each set keeps its ``limit + 1`` smallest ids, limited before the shuffle, so a value that half of all items hold costs a query no more than any other. This
    loses nothing: an item that is not among a set's smallest ids has ``limit`` others before it that share the set, or more, and have smaller ids. Where
    some item has more tokens, all items that share a token are met."""
    t = tokens.filter("dim is not null and value is not null").select("id", "dim", F.col("value").cast("string").alias("value")).distinct()
    most = t.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0
    if most > few:
        left = t.join(queries, "id", "left_semi") if queries is not None else t
        both = left.join(t.withColumnRenamed("id", "other"), ["dim", "value"]).filter(F.col("id") != F.col("other"))
        scored = both.groupBy("id", "other").agg(F.struct(F.count("*").alias("overlap"), F.count_distinct("dim").alias("dimensions")).alias("s"))
    else:
        own = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("t"))
        chosen = F.transform(F.expr("sequence(1, shiftleft(1, size(t)) - 1)"), lambda m: F.filter("t", lambda x, k: F.getbit(m, k) == 1))
        sets = own.select("id", F.explode(chosen).alias("k"))
        ids = F.row_number().over(W.partitionBy("k").orderBy("id"))
        smallest = sets.withColumn("_k", ids).filter(F.col("_k") <= limit + 1).select("k", F.col("id").alias("other"))
        asked = sets.join(queries, "id", "left_semi") if queries is not None else sets
        share = F.struct(F.size("k").cast("long").alias("overlap"), F.size(F.array_distinct(F.transform("k", lambda x: x["dim"]))).cast("long").alias("dimensions"))
        scored = asked.join(smallest, "k").filter(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.max(share).alias("s"))
    scored = scored.select("id", "other", "s.overlap", "s.dimensions")
    k = F.row_number().over(W.partitionBy("id").orderBy(F.desc("overlap"), F.desc("dimensions"), "other"))
    return scored.withColumn("rank", k).filter(F.col("rank") <= limit)


#: Distinct query terms up to which they are sent to every task; beyond, terms meet by a shuffle.
SENT_TERMS = 200_000


def terms(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, words): each text's words in order."""
    return rows.select(F.col(ident).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))


def words(rows: DataFrame, ident: str, text: str) -> DataFrame:
    return rows.select(F.col(ident).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))


def _postings(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Asked terms (query, term, qtf), postings of asked terms (term, id, part) and what every posting of a term is multiplied by (term, df, weight).

    ``part`` lies between 0 and k1 + 1. Only words that a query asks for leave the scan."""
    size = docs.select("id", F.size("words").alias("len")).filter("len > 0")
    corpus = F.broadcast(size.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")))  # one row
    q = queries.groupBy(F.col("id").alias("query"), "term").agg(F.count("*").alias("qtf"))
    wanted = q.select("term").distinct()
    if wanted.count() <= SENT_TERMS:
        wanted = F.broadcast(wanted)
    tf = docs.select("id", F.size("words").alias("len"), F.explode("words").alias("term")).join(wanted, "term", "left_semi")
    tf = tf.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    norm = F.col("tf") + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * F.col("len") / F.col("avgdl"))
    tf = tf.crossJoin(corpus).select("term", "id", "n", (F.col("tf") * (P.BM25_K1 + 1) / norm).alias("part"))
    tf = tf.persist(StorageLevel.MEMORY_AND_DISK)  # read by each pass; only postings that are asked for
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.first("n").alias("n"), F.max("part").alias("most"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return q, tf.drop("n"), df.select("term", "df", idf.alias("weight"), "most")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score, coverage) of every document that holds a term of a query. In: docs (id, words), queries (id, term), a row for each occurrence;
    repeated query terms count again. Lengths are array sizes. Corpus totals are one row; document frequencies are grouped, never collected."""
    q, tf, df = _postings(docs, queries)
    hit = q.join(df, "term").join(tf, "term")
    asked = q.groupBy("query").agg(F.count("*").alias("terms"))
    scored = hit.groupBy("query", F.col("id").alias("doc")).agg(F.sum(F.col("qtf") * F.col("weight") * F.col("part")).alias("score"), F.count("*").alias("matched"))
    return scored.join(asked, "query").select("query", "doc", "score", (F.col("matched") / F.col("terms")).alias("coverage"))


def bm25_best(docs: DataFrame, queries: DataFrame, probe: int = 2_000) -> DataFrame:
    """What ``bm25`` gives, for the documents that can be a query's best (and some others): the best of each query is always among them, with its whole score.

    A first pass scores each query by its rarest terms alone, as many as have ``probe`` postings together; the best score found is a bound that the
    query's best document reaches. Terms whose greatest possible shares do not add up to the bound cannot bring a document there by themselves: their postings, those of the
    frequent words, are not met, only asked for documents that the other terms have found."""
    q, tf, df = _postings(docs, queries)
    q = q.join(df, "term").withColumn("share", F.col("qtf") * F.col("weight")).withColumn("top", F.col("share") * F.col("most"))
    by_df = W.partitionBy("query").orderBy("df", "term")  # one row for each word of a query
    rare = q.withColumn("_sum", F.sum("df").over(by_df)).withColumn("_k", F.row_number().over(by_df)).filter((F.col("_k") == 1) | (F.col("_sum") <= probe))
    first = rare.join(tf, "term").groupBy("query", "id").agg(F.sum(F.col("share") * F.col("part")).alias("s")).groupBy("query").agg(F.max("s").alias("bound"))
    low = F.sum("top").over(W.partitionBy("query").orderBy("top", "term").rowsBetween(W.unboundedPreceding, 0))
    q = q.withColumn("_low", low).join(first, "query").withColumn("weak", F.col("_low") < F.col("bound") * (1 - 1e-9) - 1e-9)
    strong = q.filter(~F.col("weak")).join(tf, "term").groupBy("query", "id").agg(F.sum(F.col("share") * F.col("part")).alias("s"), F.count("*").alias("m"), F.first("bound").alias("bound"))
    rest = q.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("weak"), F.col("_low"))), F.lit(0.0)).alias("rest"))
    found = strong.join(rest, "query").filter(F.col("s") + F.col("rest") >= F.col("bound") * (1 - 1e-9) - 1e-9)
    more = found.select("query", "id").join(q.filter("weak").select("query", "term", "share"), "query").join(tf, ["id", "term"])
    more = more.select("query", "id", (F.col("share") * F.col("part")).alias("s"), F.lit(1).cast("long").alias("m"))
    scored = found.select("query", "id", "s", "m").unionByName(more).groupBy("query", F.col("id").alias("doc")).agg(F.sum("s").alias("score"), F.sum("m").alias("matched"))
    asked = queries.groupBy(F.col("id").alias("query")).agg(F.count_distinct("term").alias("terms"))
    return scored.join(asked, "query").select("query", "doc", "score", (F.col("matched") / F.col("terms")).alias("coverage"))


_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)


def _keys(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Words as three numbers each: their first eight bytes, the next eight, and a hash of the rest."""
    out = np.zeros((3, len(start)), np.uint64)
    for j in range(int(length.max(initial=0))):
        some = slice(None) if j == 0 else np.flatnonzero(length > j)
        c = low[start[some] + j].astype(np.uint64)
        if j < 16:
            out[j >> 3][some] |= c << np.uint64(8 * (j & 7))
        else:
            out[2][some] = (out[2][some] ^ c) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    return out


class _Asked:
    """Asked words, found among the words of many texts at once."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        length = np.array([len(w) for w in raw], np.int64)
        self.longest = int(length.max(initial=0))
        keys = _keys(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length)
        mixed = self.mix(keys)
        self.order = np.argsort(mixed, kind="stable")
        self.keys, self.mixed = keys[:, self.order], mixed[self.order]

    @staticmethod
    def mix(k: np.ndarray) -> np.ndarray:
        return k[0] ^ (k[1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (k[2] * np.uint64(0xBF58476D1CE4E5B9))

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how often), by text and word, for asked words; the number of all words of each text."""
        size, got = np.zeros(len(texts), np.int64), []
        for rows, parts in self.slices(texts):
            low = _FOLD[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], low != 0)).view(np.int8)))
            start, length = edge[::2], edge[1::2] - edge[::2]
            ends = np.cumsum([len(x) + 1 for x in parts])
            row = np.array(rows)[np.searchsorted(ends, start, side="right")]
            size += np.bincount(row, minlength=len(texts))
            fits = length <= self.longest
            start, length, row = start[fits], length[fits], row[fits]
            k = _keys(low, start, length)
            at = np.minimum(np.searchsorted(self.mixed, self.mix(k)), len(self.mixed) - 1)
            same = (self.keys[:, at] == k).all(axis=0)
            got.append(row[same] * len(self.mixed) + self.order[at[same]])
        key, often = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
        return key // max(1, len(self.mixed)), key % max(1, len(self.mixed)), often, size

    @staticmethod
    def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
        """Texts in lots of about ``most`` bytes; a longer one is cut between words. Two letters outside ASCII become ASCII when lowered."""
        rows, parts, n = [], [], 0
        for k, t in enumerate(texts):
            raw = (t or "").encode().replace("\u212a".encode(), b"k").replace("\u0130".encode(), "i\u0307".encode())
            s = 0
            while s < len(raw):
                cut = re.compile(rb"[^A-Za-z0-9]").search(raw, s + most) if s + most < len(raw) else None
                e = cut.start() if cut else len(raw)
                rows.append(k)
                parts.append(raw[s:e])
                n, s = n + e - s, e
                if n >= most:
                    yield rows, parts
                    rows, parts, n = [], [], 0
        if rows:
            yield rows, parts


def best_documents(rows: DataFrame, ident: str, text: str, queries: DataFrame, sent: int = SENT_TERMS) -> DataFrame:
    """What ``bm25`` gives for the documents that can be a query's best, read from whole texts. In: rows (ident, text), queries (id, term) as for ``bm25``.

    Queries of at most ``sent`` distinct words together go to every task: one scan counts documents, lengths and document frequencies, a second one scores
    each document where it is read and keeps a task's best of each query (and what lies within rounding of it), so that neither postings nor scores are
    shuffled. More of them meet the documents by ``bm25_best``. Words are told apart by their first 16 bytes and a 64-bit hash of the rest."""
    q = queries.groupBy(F.col("id").alias("query"), "term").agg(F.count("*").alias("qtf"))
    if not 0 < q.count() <= sent:
        return bm25_best(terms(rows, ident, text), queries)
    asked = sorted(q.collect(), key=lambda r: r["term"])
    words_, ids = sorted({r["term"] for r in asked}), list(dict.fromkeys(r["query"] for r in asked))
    place, number = {w: k for k, w in enumerate(words_)}, {i: k for k, i in enumerate(ids)}
    term = np.array([place[r["term"]] for r in asked], np.int64)
    query = np.array([number[r["query"]] for r in asked], np.int64)
    qtf = np.array([r["qtf"] for r in asked], np.float64)
    docs = rows.select(F.col(ident).alias("doc"), F.col(text).cast("string").alias("text"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df, n, size = _Asked(words_), np.zeros(len(words_), np.int64), 0, 0
        for b in batches:
            _, w, _, lengths = find.count(b.column(0).to_pylist())
            df += np.bincount(w, minlength=len(words_))
            n, size = n + int((lengths > 0).sum()), size + int(lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([n, size, *df[some].tolist()], pa.int64())], ["term", "n"])

    found = {r["term"]: r["s"] for r in docs.select("text").mapInArrow(totals, "term long, n long").groupBy("term").agg(F.sum("n").alias("s")).collect()}  # asked words at most
    n, mean = found.get(-2, 0), found.get(-1, 0) / max(1, found.get(-2, 0))
    df = np.array([found.get(k, 0) for k in range(len(words_))], np.float64)
    weight = qtf * np.log((n - df + 0.5) / (df + 0.5) + 1)[term]
    first = np.searchsorted(term, np.arange(len(words_) + 1))  # asked rows lie by word
    width, of = len(ids), np.bincount(query, minlength=len(ids))
    kinds = [queries.schema["id"].dataType, docs.schema["doc"].dataType]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, top, best = _Asked(words_), np.zeros(width), {}
        for b in batches:
            d, w, tf, lengths = find.count(b.column(1).to_pylist())
            part = tf * (P.BM25_K1 + 1) / (tf + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * lengths[d] / mean))
            each = first[w + 1] - first[w]
            share = np.zeros(len(lengths) + 1, np.int64)
            np.add.at(share, d + 1, each)
            share = np.cumsum(np.maximum(share, width))
            a = 0
            while a < len(lengths):  # documents whose scores fill about 8 MB
                z = max(a + 1, int(np.searchsorted(share, share[a] + (1 << 20))) - 1)
                i, j = np.searchsorted(d, [a, z])
                reps = each[i:j]
                row = np.repeat(first[w[i:j]], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                cell = np.repeat(d[i:j] - a, reps) * width + query[row]
                s = np.bincount(cell, np.repeat(part[i:j], reps) * weight[row], minlength=(z - a) * width).reshape(-1, width)
                m = np.bincount(cell, minlength=(z - a) * width).reshape(-1, width)
                top = np.maximum(top, s.max(axis=0))
                x, y = np.nonzero((s >= top - 1e-8) & (m > 0))
                for k, c, v, h in zip((x + a).tolist(), y.tolist(), s[x, y].tolist(), m[x, y].tolist()):
                    doc = b.column(0)[k].as_py()
                    held = best.get((c, v))
                    if held is None or (doc is not None, doc) < (held[0] is not None, held[0]):
                        best[c, v] = doc, h
                a = z
            best = {(c, v): x for (c, v), x in best.items() if v >= top[c] - 1e-8}
        out = [(ids[c], doc, v, h / of[c]) for (c, v), (doc, h) in best.items()]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*map(to_arrow_type, kinds), pa.float64(), pa.float64()])], ["query", "doc", "score", "coverage"])

    return docs.mapInArrow(score, f"query {kinds[0].simpleString()}, doc {kinds[1].simpleString()}, score double, coverage double")


def passages(cited: DataFrame, docs: DataFrame, queries: DataFrame, text: str) -> DataFrame:
    """Adds ``passage`` to citations (query, doc): the document's paragraph that holds most of the query's distinct words, verbatim, of equals the first. In: docs (id,
    text), queries (id, term). Citations are sent to the documents where queries are few, so that no text is shuffled."""
    asked = queries.groupBy(F.col("id").alias("query")).agg(F.collect_set("term").alias("_q"))
    if asked.count() <= SENT_TERMS:
        cited = F.broadcast(cited)
    d = cited.join(docs.select(F.col("id").alias("doc"), F.col(text).alias("_text")), "doc").join(asked, "query")
    parts = F.filter(F.transform(F.split("_text", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    hits = lambda p: F.size(F.array_intersect("_q", F.array_distinct(F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0)))))
    best = F.array_max(F.transform(parts, lambda p, k: F.struct(hits(p).alias("n"), (-k).alias("at"), p.alias("p"))))["p"]
    return d.select(*cited.columns, best.alias("passage"))


def cite(scored: DataFrame, least_score: float = P.CITE_SCORE, least_coverage: float = P.CITE_COVERAGE) -> DataFrame:
    """The best document of each query that passes both bars. Scores that agree to nine places are a tie: the order in which a sum was
    taken decides nothing."""
    k = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc"))
    return scored.withColumn("_k", k).filter((F.col("_k") == 1) & (F.col("score") >= least_score) & (F.col("coverage") >= least_coverage)).drop("_k")
