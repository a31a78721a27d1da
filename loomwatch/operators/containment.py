"""Which of many literals lie inside which of many texts: one pass over the texts, whatever the number of literals."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of all literals together up to which they are sent to every task as one automaton.
SENT_CHARS = 4_000_000
#: Bytes from which literals meet texts by hashes beyond that size.
GRAM = 4
#: The filter that tasks test positions against has 2^n bits, at least eight a literal; the least and the greatest n (64 MB).
LEAST_BITS, MOST_BITS = 20, 29
#: A character of a word, and any other (an ASCII class, which Java looks up; a negated list of ranges takes it several times as long).
WORD, APART = r"\w", r"\W"
#: Literals meet texts by their words if their cores have that many counts of words at most (each word of a text begins as many runs), none of them above the
#: second number, and none of them is shared by more literals of one length than the third.
CORE_COUNTS, CORE_WORDS, CORE_SHARED = 8, 32, 1000
#: Characters of a text that are cut into runs at a time.
PART_CHARS = 1 << 18


@functools.lru_cache(maxsize=4)
def automaton(literals: tuple[str, ...]):
    """An Aho-Corasick automaton over distinct literals that gives their positions in the tuple."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in enumerate(literals):
        a.add_word(w, k)
    a.make_automaton()
    return a


def _found(texts: DataFrame, ident: str, text: str, literals: tuple[str, ...]) -> DataFrame:
    """(ident, _lit) by one automaton in every task."""
    kind = texts.schema[ident].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(literals)
        for b in batches:
            ids, lits = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hit = {k for _, k in find.iter(t)} if t and literals else ()
                ids += [d] * len(hit)
                lits += [literals[k] for k in hit]
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(lits, pa.string())], [ident, "_lit"])

    return texts.select(ident, text).mapInArrow(run, f"{ident} {kind.simpleString()}, _lit string")


def _doubled(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, hashes of the p bytes from every position) for p = GRAM, 2 GRAM, ...: each from two halves."""
    h = raw.astype(np.uint64) + np.uint64(1)
    p = 1
    while p <= len(raw):
        if p >= GRAM:
            yield p, h
        h = _mixed(h[: max(0, len(h) - p)], h[p:])
        p *= 2


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slot(h: np.ndarray, size: int | np.ndarray, bits: int) -> np.ndarray:
    """Where a hash of ``size`` bytes stands in a filter of 2^bits bits."""
    return ((h ^ (np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _has(filter_: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (filter_[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _slices(texts: list[bytes], most: int, overlap: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts (their places, bytes) of about ``most`` bytes together; a longer one goes in parts that share ``overlap`` bytes."""
    rows, parts, n = [], [], 0
    for k, t in enumerate(texts):
        for s in range(0, max(1, len(t) - overlap), most):
            rows.append(k)
            parts.append(t[s : s + most + overlap])
            n += len(parts[-1])
            if n >= most:
                yield rows, parts
                rows, parts, n = [], [], 0
    if rows:
        yield rows, parts


def _by_hash(texts: DataFrame, ident: str, text: str, literals: DataFrame, lengths: dict[int, int] | None = None) -> DataFrame:
    """(ident, _lit) for literals of GRAM bytes and more, beyond what can be sent: the substrings of a text that may be a literal (every one that is, and a few
    that are not) leave their task. Literals which begin alike are as far apart as others. ``lengths``: how many distinct literals have so many bytes.

    What every task gets is a filter of bounded size: it knows each literal by its first p bytes (p: the greatest GRAM 2^k that fits) and as a whole (from
    its first and its last p bytes, its length and their hashes). A position is tried against the first of these, then against the lengths that occur."""
    kind = texts.schema[ident].dataType
    spark = texts.sparkSession
    if lengths is None:
        lengths = {r["n"]: r["c"] for r in literals.distinct().groupBy(F.octet_length("_lit").alias("n")).agg(F.count("*").alias("c")).collect()}
    sizes: dict[int, list[int]] = {}
    total = sum(lengths.values())
    for n in lengths:
        sizes.setdefault(GRAM << ((n // GRAM).bit_length() - 1), []).append(n)
    longest = max((n for some in sizes.values() for n in some), default=0)
    log = min(MOST_BITS, max(LEAST_BITS, (8 * total).bit_length()))
    width = (1 << log) // 8

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.uint8)
        for b in batches:
            raw = [x.encode() for x in b.column(0).to_pylist()]
            for _, parts in _slices(raw, 1 << 20, longest):
                ends = np.cumsum([len(x) for x in parts])
                length = np.array([len(x) for x in parts])
                for p, h in _doubled(np.frombuffer(b"".join(parts), np.uint8)):
                    own = (length >= p) & (length < 2 * p)
                    first = h[(ends - length)[own]]
                    for slot in (_slot(first, p, log), _slot(_mixed(first, h[(ends - p)[own]]), length[own], log)):
                        np.bitwise_or.at(seen, slot >> np.uint64(3), np.left_shift(1, slot & np.uint64(7), dtype=np.uint64).astype(np.uint8))
        for k in np.flatnonzero(seen.reshape(-1, 4096).any(axis=1)).tolist():  # only the parts that are not empty
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen[k * 4096 : (k + 1) * 4096].tobytes()], pa.binary())], ["part", "bits"])

    merged = np.zeros(width, np.uint8)

    def either(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    parts = literals.select("_lit").mapInArrow(bits, "part int, bits binary").groupBy("part").applyInArrow(either, "part int, bits binary")
    for r in parts.collect():  # 2^MOST_BITS / 8 bytes at most
        merged[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(zlib.compress(merged.tobytes(), 1))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for b in batches:
            for rows, some in _slices([(t or "").encode() for t in b.column(1).to_pylist()], 1 << 20, max(0, longest - 1)):
                whole, length = b"".join(some), np.array([len(x) for x in some])
                of = np.repeat(np.arange(len(some)), length)
                left = np.repeat(np.cumsum(length), length) - np.arange(len(whole))  # bytes up to the end of the own text
                at, found = [], []
                for p, h in _doubled(np.frombuffer(whole, np.uint8)):
                    if p not in sizes:
                        continue
                    may = np.flatnonzero(_has(filter_, _slot(h, p, log)) & (left[: len(h)] >= p))
                    for n in sizes[p]:
                        k = may[left[may] >= n]
                        k = k[_has(filter_, _slot(_mixed(h[k], h[k + (n - p)]), n, log))]
                        at.append(k)
                        found += [whole[i : i + n] for i in k.tolist()]
                where = np.array(rows)[of[np.concatenate(at)]].tolist() if found else []
                once = list(dict.fromkeys(zip(where, found)))  # of a text that repeats itself, each substring leaves once a slice
                ids = b.column(0).take(pa.array([k for k, _ in once], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([w for _, w in once], pa.binary())], [ident, "_bytes"])

    found = texts.select(ident, text).mapInArrow(places, f"{ident} {kind.simpleString()}, _bytes binary")
    return found.select(ident, F.col("_bytes").cast("string").alias("_lit"))


def _short(texts: DataFrame, ident: str, text: str, literals: DataFrame) -> DataFrame:
    """(ident, _lit) for literals below GRAM bytes: the distinct substrings of a text that are as long as one of them."""
    out = texts.select(ident).limit(0).withColumn("_lit", F.lit(""))
    for size in [r["n"] for r in literals.select(F.length("_lit").alias("n")).distinct().collect()]:  # GRAM at most
        at = F.sequence(F.lit(1), F.length(text) - size + 1)
        each = F.explode(F.array_distinct(F.transform(at, lambda k: F.substring(F.col(text), k, F.lit(size)))))
        parts = texts.filter(F.length(text) >= size).select(ident, each.alias("_lit"))
        out = out.unionByName(parts.join(literals, "_lit", "left_semi"))
    return out


def _core(literal: Column) -> Column:
    """From the first to the last word of a literal that has something else on both sides of it; empty where it has none."""
    return F.regexp_extract(literal, rf"^{WORD}*+{APART}++({WORD}(?s:.*){WORD}|{WORD}){APART}++{WORD}*+\z", 1)


def _by_core(texts: DataFrame, ident: str, text: str, rows: DataFrame, literal: str, counts: list[int], longest: int) -> DataFrame:
    """ident and all columns of ``rows`` where the text contains the literal, perhaps more than once. Every literal has a core of one of the ``counts`` of words
    and ``longest`` bytes at most.

    Where a literal stands in a text, the words of its core are whole words of the text: the core is so many words of the text in a row. Each such run of a
    text meets the literals by its hash, with the words before and behind it, in which the literal must stand. Long texts go in parts that share a literal's length."""
    cut = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(PART_CHARS)), lambda k: F.substring(text, k + 1, F.lit(PART_CHARS + longest)))
    parts = F.when(F.octet_length(text) > PART_CHARS, cut).otherwise(F.array(text))
    d = texts.select(ident, F.explode_outer(parts).alias("_t"))
    lead = f"{WORD}*+{APART}++"  # a run is looked at from the word before it, and the next one from its own first word
    runs = [F.regexp_extract_all("_t", F.lit(f"(?=({lead}{WORD}++{f'{APART}++{WORD}++' * (n - 1)}{APART}++{WORD}*+)){lead}"), F.lit(1)) for n in counts]
    # an outer explode is not looked through for rows that it would drop, which takes the expressions a second time
    around = d.select(ident, F.explode_outer(F.concat(*runs)).alias("_around")).filter("_around is not null")
    key = lambda c: F.xxhash64(_core(F.col(c))).alias("_key")
    return around.select("*", key("_around")).join(rows.select("*", key(literal)), "_key").filter(F.contains("_around", literal)).drop("_key", "_around")


def _plan(literals: DataFrame, sent_chars: int) -> tuple[bool, list[int] | None, dict[int, int]]:
    """Whether the literals (``_lit``) can be sent; else the counts of words of their cores, if these are few and tell literals apart; and how many distinct literals
    have so many bytes (no fewer than there are). One pass over the literals; distinct lengths and counts of words only reach the driver."""
    core = _core(F.col("_lit"))
    own = F.xxhash64("_lit").alias("own")
    each = literals.select(core.alias("core"), own, F.octet_length("_lit").alias("n"), F.length("_lit").alias("chars"))
    each = each.select("*", F.when(F.col("core") != "", F.xxhash64("core")).otherwise(F.col("own")).alias("key"), F.when(F.col("core") != "", F.regexp_count("core", F.lit(f"{APART}++")) + 1).otherwise(0).alias("words"))
    of_key = each.groupBy("key", "words", "n").agg(F.count("*").alias("c"), F.max("chars").alias("chars"), (F.min("own") == F.max("own")).alias("one"))
    of_key = of_key.withColumn("c", F.when(F.col("one"), 1).otherwise(F.col("c")))
    sizes = of_key.groupBy("words", "n").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("chars")).alias("chars"), F.max("c").alias("most")).collect()
    lengths: dict[int, int] = {}
    for r in sizes:
        lengths[r["n"]] = lengths.get(r["n"], 0) + r["c"]
    counts = sorted({r["words"] for r in sizes})
    told = 0 < len(counts) <= CORE_COUNTS and counts[0] > 0 and counts[-1] <= CORE_WORDS and max(r["most"] for r in sizes) <= CORE_SHARED
    return sum(r["chars"] for r in sizes) <= sent_chars, counts if told else None, lengths


def _candidates(texts: DataFrame, literals: DataFrame, ident: str, text: str, sent: bool, lengths: dict[int, int]) -> DataFrame:
    """(ident, _lit): each text with every literal (``_lit``, not empty) that it contains, and perhaps with other substrings of it: an equi-join with the literals
    leaves what is right. What was found in one place may come from another again."""
    if sent:
        return _found(texts, ident, text, tuple(sorted(r["_lit"] for r in literals.distinct().collect())))
    of_grams = {n: c for n, c in lengths.items() if n >= GRAM}  # distinct lengths only
    out = _by_hash(texts, ident, text, literals.filter(F.octet_length("_lit") >= GRAM), of_grams)
    return out.unionByName(_short(texts, ident, text, literals.filter(F.octet_length("_lit") < GRAM).distinct())) if len(of_grams) < len(lengths) else out


def contained(texts: DataFrame, literals: DataFrame, ident: str, text: str, literal: str, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(ident, literal): each text with each distinct literal that it contains, once. Null and empty literals lie nowhere, null texts hold nothing.

    Literals that are no more than ``sent_chars`` characters together go to every task as one automaton. Beyond, literals of few shapes meet the texts by their
    words; else those of GRAM bytes and more meet the substrings that a filter of hashes lets through, shorter ones all substrings of their length. Nothing that
    grows with the literals is sent."""
    lits = literals.select(F.col(literal).alias("_lit")).filter("_lit <> ''")
    sent, counts, lengths = _plan(lits, sent_chars)
    if counts and not sent:
        return _by_core(texts, ident, text, lits.distinct(), "_lit", counts, max(lengths)).distinct().withColumnRenamed("_lit", literal)
    return _candidates(texts, lits, ident, text, sent, lengths).join(lits, "_lit", "left_semi").select(ident, "_lit").distinct().withColumnRenamed("_lit", literal)


def contained_rows(texts: DataFrame, rows: DataFrame, ident: str, text: str, literal: str, sent_chars: int = SENT_CHARS) -> DataFrame:
    """``contained`` joined with ``rows`` that have the literal as a column, in one join: ident and all columns of ``rows``, perhaps more than once."""
    rows = rows.filter(F.col(literal) != "")
    lits = rows.select(F.col(literal).alias("_lit"))
    sent, counts, lengths = _plan(lits, sent_chars)
    if counts and not sent:
        return _by_core(texts, ident, text, rows, literal, counts, max(lengths))
    return _candidates(texts, lits, ident, text, sent, lengths).withColumnRenamed("_lit", literal).join(rows, literal)
