"""Redaction with stable tokens per scope: addresses, then user names, then known users and hosts, numbered by first appearance.

A text is marked once: what is to be masked stands between control characters (which redaction takes out first, so that none is left in a text), with a letter for
its kind. What is marked is never looked at again, so kinds stay apart and nothing is replaced twice. Tokens are rows (scope, kind, value, token); they
meet the marks of each distinct text of a scope by an equi-join, come back as one array a text, and the text is put together from its pieces: a scope of any
number of tokens costs what its marks cost.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.functions.prefix import BLOCK
from loomwatch.operators.containment import automaton
from loomwatch.session import written

LINE_CAP = P.LINE_CHARS  # of a log line; longer ones are no log lines
OPEN, CLOSE = "\x01", "\x02"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
MARK = re.compile(f"{OPEN}[^{CLOSE}]*{CLOSE}")
KINDS = {"I": "IP", "U": "USER", "H": "HOST"}
#: Known names up to which they go to every task; beyond, texts meet their scope's names in salted groups.
SENT_NAMES = 200_000
GROUP_TEXTS = 20_000


def clean(text: Column, cap: int | None = None) -> Column:
    """Control characters out; at most ``cap`` characters, if given (LINE_CAP for log lines)."""
    t = F.regexp_replace(text, CONTROL, "")
    return t if cap is None else F.substring(t, 1, cap)


def _cues(text: Column) -> tuple[Column, Column, Column]:
    """Whether a text may hold addresses of either kind, or user names: cheap tests that let most texts pass the patterns by."""
    names = [F.contains(text, F.lit(c)) for c in P.USER_CUES]
    return F.rlike(text, F.lit(P.IOC_IP_CUE)), F.rlike(text, F.lit(P.IPV6_CUE)), functools.reduce(Column.__or__, names)


def marked(text: Column) -> Column:
    """The clean text with its addresses and user names between marks, in the order in which kinds are looked for. Names are looked for outside the marks that
    are there; a name's pattern may begin before a mark and go on behind it."""
    ip, v6, user = _cues(text)
    t = F.when(ip, F.regexp_replace(text, P.IOC_IP, f"{OPEN}I$0{CLOSE}")).otherwise(text)
    named = t = F.when(v6, F.regexp_replace(t, P.IPV6, f"{OPEN}I$0{CLOSE}")).otherwise(t)
    for rx in P.USER_NAMES:
        before, name, after = re.fullmatch(r"(.*?)(\([^?].*?\))(\(\?=.*\))?", rx).groups()
        name = name.replace("[^'", f"[^'{OPEN}{CLOSE}")
        lead = before if before.startswith("(?<=") else f"({before})"
        keep, pick = ("$1", "$2") if before.startswith("(?<=") else ("$1$2", "$3")
        # a mark is stepped over as a match of its own, which leaves an empty mark behind
        named = F.regexp_replace(named, f"({OPEN}[^{CLOSE}]*{CLOSE})|{lead}{name}{after or ''}", f"{keep}{OPEN}U{pick}{CLOSE}")
        named = F.replace(named, F.lit(f"{OPEN}U{CLOSE}"), F.lit(""))
    return F.when(user, named).otherwise(t)


def pieces(mark: Column) -> Column:
    """Plain text at even places, kind letter and value at odd ones."""
    return F.split(mark, f"[{OPEN}{CLOSE}]", -1)


def _outside(text: str, names: dict[str, str], find) -> str:
    """``text`` with known names between marks: whole words outside the marks that are there, users before hosts, the longest first."""
    word = lambda c: c.isalnum() or c == "_"
    hits, most = [], len(text)
    for end, n in find(text):
        a, b = end + 1 - len(n), end + 1
        if word(text[a]) != (a > 0 and word(text[a - 1])) and word(text[end]) != (b < most and word(text[b])):
            hits.append((names[n] != "USER", a - b, n, a, b))
    if not hits:
        return text
    taken = [m.span() for m in MARK.finditer(text)] if OPEN in text else []
    put = []
    for _, _, n, a, b in sorted(hits):
        k = bisect.bisect_left(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b))
            put.append((a, b, n))
    parts, done = [], 0
    for a, b, n in sorted(put):
        parts += (text[done:a], OPEN, names[n][0], n, CLOSE)
        done = b
    return "".join(parts) + text[done:]


def _with_known(texts: DataFrame, known: DataFrame, sent: int) -> DataFrame:
    """``texts`` (scope, mark, others) with names of their scope's list marked too. In: known (scope, kind, value); a null scope means every one."""
    known = known.filter("value is not null and value not in ('', '—')").select("scope", "kind", "value").distinct()
    back, at = texts.columns, texts.columns.index("mark")

    def finder(rows: list[tuple[str, str]]):
        names: dict[str, str] = {}
        for k, v in sorted(rows, key=lambda r: r[0] != "USER"):
            names.setdefault(v, k)
        words = tuple(sorted(names))
        a = automaton(words) if words else None
        return names, (lambda p: [(end, words[n]) for end, n in a.iter(p)]) if a is not None else (lambda p: [])

    few = known.limit(sent + 1).collect()  # counted and fetched in one pass
    if len(few) <= sent:
        lists: dict[object, list[tuple[str, str]]] = {}
        for r in few:
            lists.setdefault(r["scope"], []).append((r["kind"], r["value"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[object, tuple] = {}
            for b in batches:
                out = []
                for s, t in zip(b.column("scope").to_pylist(), b.column("mark").to_pylist()):
                    s = s if s in lists else None
                    if s not in made:
                        if len(made) > 3:
                            made.clear()
                        made[s] = finder([*lists.get(None, []), *(lists[s] if s is not None else [])])
                    out.append(None if t is None else _outside(t, *made[s]))
                yield b.set_column(at, "mark", pa.array(out, pa.string()))

        return texts.mapInArrow(run, texts.schema)
    if known.filter("scope is null").head(1):
        raise ValueError(f"more than {sent} known names need a scope each")
    sizes = texts.groupBy("scope").agg(F.ceil(F.count("*") / GROUP_TEXTS).cast("int").alias("_salts"))
    salted = texts.join(sizes, "scope", "left").withColumn("_salt", F.pmod(F.xxhash64("mark"), F.coalesce("_salts", F.lit(1)))).select(*back, "_salt")
    copies = known.join(sizes, "scope").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - F.lit(1).cast("long")))).select("scope", "kind", "value", "_salt")

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        names = finder(list(zip(right.column("kind").to_pylist(), right.column("value").to_pylist())))
        out = [None if t is None else _outside(t, *names) for t in left.column("mark").to_pylist()]
        return left.select(back).set_column(at, "mark", pa.array(out, pa.string()))

    return salted.groupBy("scope", "_salt").cogroup(copies.groupBy("scope", "_salt")).applyInArrow(group, texts.schema)


def _cued(text: Column) -> Column:
    """Whether the clean text may hold a mark, told from the text as it is: what is taken out of it may stand within a cue."""
    return functools.reduce(Column.__or__, _cues(text), F.rlike(text, F.lit(CONTROL)))


def _marks(texts: DataFrame, known: DataFrame | None, sent: int) -> DataFrame:
    """``texts`` (scope, key, first, _t) with the marks of the clean text ``_t``: (scope, key, first, mark)."""
    d = texts.select("scope", "key", "first", marked(F.col("_t")).alias("mark"))
    return d if known is None else _with_known(d, known, sent)


def _distinct(rows: DataFrame, scope: str, order: str, text: str, cap: int | None) -> DataFrame:
    """Each distinct clean text of a scope, once: (scope, key, first, _t). ``key`` is the text's digest, ``first`` the order in which it comes first."""
    d = rows.select(F.col(scope).alias("scope"), F.col(order).alias("_o"), clean(F.col(text), cap).alias("_t")).filter(F.col(text).isNotNull())
    # the text is a key beside its digest: aggregates that hold strings are sorted, keys are hashed
    return d.withColumn("key", F.unhex(F.sha2("_t", 256))).groupBy("scope", "key", "_t").agg(F.min("_o").alias("first")).select("scope", "key", "first", "_t")


def _values(marks: DataFrame) -> DataFrame:
    """(scope, key, first, at, kind, value) of every mark; ``at`` counts the marks of a text from 0."""
    d = marks.select("scope", "key", "first", F.posexplode(F.regexp_extract_all("mark", F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))).alias("at", "_v"))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return d.select("scope", "key", "first", "at", F.element_at(kind, F.substring("_v", 1, 1)).alias("kind"), F.expr("substring(_v, 2)").alias("value"))


def _numbered(values: DataFrame) -> DataFrame:
    """(scope, kind, value, token) by first appearance. Ranks are counted in blocks of the order (where it is a number) that hand on their totals."""
    d = written(values.groupBy("scope", "kind", "value").agg(F.min(F.struct("first", "at")).alias("_f")))
    whole = values.schema["first"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    d = d.withColumn("_blk", F.expr(f"_f.first div {BLOCK}") if whole else F.lit(0))
    inside = F.row_number().over(W.partitionBy("scope", "kind", "_blk").orderBy("_f", "value"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("scope", "kind").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = d.groupBy("scope", "kind", "_blk").agg(F.count("*").alias("_n")).select(F.col("scope").alias("_s"), F.col("kind").alias("_k"), F.col("_blk").alias("_b"), before.alias("_base"))
    same = F.col("scope").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_k")) & F.col("_blk").eqNullSafe(F.col("_b"))
    j = d.withColumn("_in", inside).join(base, same)
    return j.select("scope", "kind", "value", F.concat(F.lit("["), "kind", F.lit("-"), (F.col("_base") + F.col("_in")).cast("string"), F.lit("]")).alias("token"))


def token_table(rows: DataFrame, scope: str, order: str, text: str, cap: int | None = None, known: DataFrame | None = None, sent: int = SENT_NAMES) -> DataFrame:
    """(scope, kind, value, token): every address, user name and known name of a scope, numbered within its kind by first appearance."""
    if known is not None:
        return _numbered(_values(_marks(_distinct(rows, scope, order, text, cap), known, sent)))
    # only values leave the tasks: a copy of a text has the same ones, and most texts have none
    d = rows.filter(_cued(F.col(text))).select(F.col(scope).alias("scope"), F.lit(None).alias("key"), F.col(order).alias("first"), clean(F.col(text), cap).alias("_t"))
    return _numbered(_values(_marks(d, None, sent)))


def redact(rows: DataFrame, scope: str, order: str, text: str, cap: int | None = None, known: DataFrame | None = None, sent: int = SENT_NAMES) -> DataFrame:
    """Adds ``redacted``. ``known`` (scope, kind ``USER`` or ``HOST``, value) lists names that are masked wherever they stand as whole words, the longest first; a
    null scope means every one. Null texts stay null; a null scope is a scope; a value that is both an address and a name is an address."""
    marks = written(_marks(_distinct(rows, scope, order, text, cap), known, sent))
    values = _values(marks)
    tokens = _numbered(values)
    of = tokens.select(F.col("scope").alias("_ts"), F.col("kind").alias("_k"), F.col("value").alias("_v"), "token")
    same = F.col("scope").eqNullSafe(F.col("_ts")) & (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v"))
    of_text = values.join(of, same).groupBy(F.col("scope").alias("_ts"), F.col("key").alias("_tk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("_tokens")
    )
    whole = marks.join(of_text, F.col("scope").eqNullSafe(F.col("_ts")) & (F.col("key") == F.col("_tk")), "left").drop("_ts", "_tk")
    put = F.transform(pieces(F.col("mark")), lambda p, k: F.when(k % 2 == 1, F.get("_tokens", F.floor(k / 2).cast("int"))).otherwise(p))
    done = whole.select(F.col("scope").alias("_ts"), F.col("key").alias("_tk"), F.array_join(put, "").alias("redacted"))
    own = rows.withColumn("_key", F.unhex(F.sha2(clean(F.col(text), cap), 256)))
    return own.join(done, F.col(scope).eqNullSafe(F.col("_ts")) & (F.col("_key") == F.col("_tk")), "left").select(*rows.columns, "redacted")


def seeds(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Known names of each run, as ``redact`` takes them: hosts of events and derived hosts of findings, users that rules named. In: findings (run_id, host,
    host_derived, user, usernames), events (run_id, host)."""
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    users = F.transform(F.concat(F.array("user"), F.coalesce("usernames", F.array().cast("array<string>"))), lambda u: row("USER", u))
    f = findings.select(F.col("run_id").alias("scope"), F.explode(F.concat(users, F.array(row("HOST", F.when(F.col("host_derived"), F.col("host")))))).alias("x"))
    e = events.select(F.col("run_id").alias("scope"), row("HOST", F.col("host")).alias("x"))
    return f.unionByName(e).select("scope", "x.*").filter("value is not null and value not in ('', '—')").distinct()


def remap(rows: DataFrame, text: str, mapping: dict[str, str]) -> DataFrame:
    """Replaces whole tokens in one pass, the longest first; what was put in is not replaced again."""
    rx = "|".join(rf"(?<![\w.]){re.escape(k)}(?![\w])" for k in sorted(mapping, key=len, reverse=True))

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        import re

        one = re.compile(rx)
        return s.map(lambda t: t if t is None else one.sub(lambda m: mapping[m.group(0)], t))

    return rows.withColumn(text, apply(F.col(text))) if mapping else rows
