"""Removal of long repeated substrings by a distributed, common-prefix-aware merge sort of suffixes.

Only suffixes that start at *anchors* are sorted. A window of ``length`` bytes has one canonical anchor, the
leftmost of its ``gram``-byte strings with the smallest hash; equal windows have it at the same offset. So an
anchor whose gram occurs once in the corpus answers for windows that occur once, and only anchors with a repeated
gram go on, with the text to their right and left that their windows cover.

Sort: tasks sort runs of anchor suffixes and exchange them front-coded (common prefix length with the row before, then
the rest). Suffixes are ordered by the hash of their gram, then by their bytes, so that ranges of equal width hold equally many
grams and their number follows from the row count. The receiver merges the runs of its range with a loser tree that keeps for
each run the common prefix with the last row put out, compares only from there on, and yields every row with its common prefix.

A window at offset o before its anchor is repeated if another anchor of the gram agrees with it on o bytes to the left and
``length`` - o to the right. The receiver settles this from the order alone: neighbouring ranges of a gram are united by falling
common prefix, and where a row of the smaller range falls into the left order of the larger one, the two beside it
give the pairs (left, right) of extensions that no other pair exceeds. Nothing but runs of repeated windows leaves the task.

Grams with more than ``hot`` anchors (some 60 MB of text) do not meet in one task. Their rows are sorted as ranges cut at splitters, once by the
right and once by the left; neighbours prove windows repeated and bound what can be. What proof and bound leave open is
settled by counting 128-bit digests, which a row shows only where it differs from the row before it in right order.

Defined results: null counts as empty; texts shorter than ``length`` keep everything; overlapping copies count, in one
text too; repeated rows are copies of each other; rows with null doc_ids take part; a very long text is hashed in chunks and
its anchors travel like any others; an empty table gives no rows; extra columns, whatever their names, are ignored
(``repeated_spans``) or passed through (``cut_repeats``).
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.common import free_name, materialise, one_key_each, partitions_for, restore, shared_dir, squeeze, text_slices
from loomwatch.llm.words import mix, text_bytes

POS_BITS = 18
CHUNK = (1 << 17) - 1024
MOST_BUCKETS = 50_000  # Spark allows 100000
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """The rows with a number of their own, written once, in buckets by it: joins by the number move no text. A bucket holds
    some 16000 rows, above 800 million rows more. The table's name leaves the catalog at once; its files stay in the shared folder."""
    spark = docs.sparkSession
    n = bucket_count(docs.count(), partitions_for(spark))
    name = f"loomwatch_{uuid.uuid4().hex}"
    (
        docs.withColumn(row, F.monotonically_increasing_id())
        .repartition(n, row)
        .write.bucketBy(n, row)
        .option("path", f"{shared_dir(spark).rstrip('/')}/{name}")
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def bucket_count(rows: int, least: int) -> int:
    return min(MOST_BUCKETS, max(least, -(-rows // 16_000)))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on (a power of two), by doubling."""
    h = _BYTES[data]
    step, mul = 1, 0x9E3779B97F4A7C15
    while step < gram:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        left = h[:-step] * np.uint64(mul)
        left += h[step:]
        h = left
        mul = mul * mul * 0x2545F4914F6CDD1D % (1 << 64)
        step *= 2
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, gram hash, anchor within the text, its smallest and its largest offset in a window), chunk by chunk."""
    low = np.uint64((1 << POS_BITS) - 1)
    sizes = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int32)  # windows that lie in one text
    ok = sizes >= length
    np.add.at(valid, offsets[:-1][ok], 1)
    np.add.at(valid, offsets[1:][ok] - length + 1, -1)
    valid = valid.cumsum()[:-1] > 0 if len(data) else valid[:0]
    found: list[list[np.ndarray]] = [[], [], [], []]
    at0 = np.arange(CHUNK + length, dtype=np.uint64)
    for s in range(0, len(data) - length + 1, CHUNK):
        h = gram_hashes(data[s : s + CHUNK + length - 1], gram)
        v = (h & ~low) | at0[: len(h)]
        at = (sliding_min(v, length - gram + 1) & low).astype(np.int64)
        win = np.flatnonzero(valid[s : s + len(at)])
        if not len(win):
            continue
        a = at[win]
        new = np.ones(len(win), bool)
        new[1:] = (a[1:] != a[:-1]) | (win[1:] != win[:-1] + 1)
        starts = np.flatnonzero(new)
        first, last, a = win[starts], win[np.append(starts[1:], len(win)) - 1], a[starts]
        for col, x in zip(found, (mix(h[a]), a + s, first + s, last + s)):  # mixed again: the smallest hashes are no even sample
            col.append(x)
    if not found[0]:
        return (np.zeros(0, np.int64),) * 5
    kh, a, first, last = (np.concatenate(c) for c in found)
    new = np.ones(len(a), bool)  # an anchor whose windows lie in two chunks is one
    new[1:] = (a[1:] != a[:-1]) | (first[1:] != last[:-1] + 1)
    starts = np.flatnonzero(new)
    kh, a, first, last = kh[starts], a[starts], first[starts], last[np.append(starts[1:], len(a)) - 1]
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, kh.view(np.int64), a - offsets[doc], a - last, a - first


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """row, kh, a, o1, o2, multi (met again in the same slice of texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 8 << 20):
            doc, kh, *cols = anchors_of(*text_bytes(b.column("text")), length, gram)
            _, inverse, count = np.unique(kh, return_inverse=True, return_counts=True)
            multi = count[inverse] > 1 if len(doc) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pa.array(doc)), pa.array(kh), *(pa.array(c.astype(np.int32)) for c in cols), pa.array(multi)],
                ["row", "kh", "a", "o1", "o2", "multi"],
            )

    return docs.select("row", "text").mapInArrow(run, "row long, kh long, a int, o1 int, o2 int, multi boolean")


def with_anchors(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """row, text, xs: documents that hold such anchors. Only the anchors move: the texts lie in buckets by row."""
    return docs.select("row", "text").join(kept.groupBy("row").agg(F.collect_list(F.struct("kh", "a", "o1", "o2")).alias("xs")), "row")


def context_rows(b: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, bytes, tuple[int, ...], int]]:
    """(text to the right of each anchor, to its left (reversed), (row, a, o1, o2), gram hash)."""
    for k in range(b.num_rows):
        data, row, xs = b.column("text")[k].as_py().encode(), b.column("row")[k].as_py(), b.column("xs")[k].values
        for kh, a, o1, o2 in zip(*(xs.field(c).to_pylist() for c in ("kh", "a", "o1", "o2"))):
            yield data[a : a - o1 + length], data[a - o2 : a][::-1], (row, a, o1, o2), kh


# --- the merge sort -------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which are known to agree before ``at``."""
    n = min(len(a), len(b))
    step = 16
    while at < n:
        p, q = a[at : at + step], b[at : at + step]
        if p != q:
            m = min(len(p), len(q), n - at)
            x = int.from_bytes(p[:m], "big") ^ int.from_bytes(q[:m], "big")
            return at + m - (x.bit_length() + 7) // 8
        at += step
        step *= 4
    return n


def front_code(rows: list[tuple[bytes, bytes, tuple]]) -> bytes:
    """Sorted (key, tie, ids) rows: each key without the prefix that it shares with the key before, and likewise a tie
    where the keys are equal. Numbers and bytes lie apart, compressed."""
    numbers, keys, ties = [], [], []
    before, last = b"", b""
    for key, tie, ids in rows:
        p = common_prefix(before, key)
        t = common_prefix(last, tie) if key == before else 0
        numbers.append((p, len(key) - p, t, len(tie) - t, *ids))
        keys.append(key[p:])
        ties.append(tie[t:])
        before, last = key, tie
    parts = [squeeze(np.array(c, "<i8")) for c in zip(*numbers)] + [squeeze(np.frombuffer(b"".join(x), "u1")) for x in (keys, ties)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


class Run:
    """Reads a front-coded run row by row; ``h`` is the common prefix of the row with the row read before."""

    __slots__ = ("numbers", "keys", "ties", "at", "ties_at", "key", "tie", "ids", "h", "done")

    def __init__(self, data: bytes):
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        self.numbers = zip(*(restore(p, "<i8").tolist() for p in parts[:-2]))
        self.keys, self.ties = (restore(p, "u1").tobytes() for p in parts[-2:])
        self.at = self.ties_at = 0
        self.key, self.tie, self.ids, self.done = b"", b"", (), False
        self.step()

    def step(self) -> None:
        got = next(self.numbers, None)
        if got is None:
            self.done = True
            return
        p, rest, t, tie, *ids = got
        s, e = self.at, self.ties_at
        self.key = self.key[:p] + self.keys[s : s + rest]
        self.tie = self.tie[:t] + self.ties[e : e + tie]
        self.ids, self.h, self.at, self.ties_at = tuple(ids), p, s + rest, e + tie


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes, tuple]]:
    """Rows of all runs in order, each with its common prefix with the row before. A loser tree: every waiting run
    knows its common prefix with the last winner of its node; a longer one wins unseen, equal ones are compared
    from there on only."""
    k = len(runs)
    if not k:
        return
    tree = [-1] * k  # tree[0]: winner; others: loser at the node

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's h becomes its common prefix with the winner."""
        a, b = runs[x], runs[y]
        if a.done or b.done:
            return (y, x) if a.done else (x, y)
        if a.h != b.h:
            return (x, y) if a.h > b.h else (y, x)
        h = common_prefix(a.key, b.key, a.h)
        ka, kb = a.key[h : h + 1], b.key[h : h + 1]
        less = ka < kb or ka == kb and (a.tie, a.ids) <= (b.tie, b.ids)
        if less:
            b.h = h
            return x, y
        a.h = h
        return y, x

    for r in runs:
        r.h = 0
    for x in range(k):
        w, node = x, (x + k) // 2
        while node > 0:
            if tree[node] == -1:
                tree[node] = w
                break
            w, tree[node] = play(w, tree[node])
            node //= 2
        else:
            tree[0] = w
    while not runs[tree[0]].done:
        w = tree[0]
        r = runs[w]
        yield r.h, r.key, r.tie, r.ids
        r.step()
        node = (w + k) // 2
        while node > 0:
            w, tree[node] = play(w, tree[node])
            node //= 2
        tree[0] = w


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Run]]]:
    """The runs of one range at a time, from batches sorted by part."""
    part, runs = None, []
    for b in batches:
        for p, r in zip(b.column("part").to_pylist(), b.column("run").to_pylist()):
            if p != part:
                if runs:
                    yield part, runs
                part, runs = p, []
            runs.append(Run(r))
    if runs:
        yield part, runs


# --- what the order says ----------------------------------------------------------------------------------------


def settle_gram(rows: list[tuple[int, bytes, bytes, tuple]], length: int) -> Iterator[tuple[int, int, int]]:
    """(row, first window, last window) of every run of repeated windows of one gram, whose rows (common prefix with the one
    before, text to the right, text to the left, (row, a, o1, o2)) come in order."""
    same: list[list[tuple]] = []  # rows with equal text on both sides
    lcp, rights, lefts = [], [], []
    for h, right, left, ids in rows:
        if same and right == rights[-1] and left == lefts[-1]:
            same[-1].append(ids)
            continue
        lcp.append(h)
        rights.append(right)
        lefts.append(left)
        same.append([ids])
    m = len(same)
    met: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def pair(x: int, y: int, r: int) -> None:
        if r + len(lefts[x]) >= length and r + len(lefts[y]) >= length:
            e = common_prefix(lefts[x], lefts[y])
            if r + e >= length:
                met[x].append((length - r, e))
                met[y].append((length - r, e))

    if m == 2:
        pair(0, 1, lcp[1])
    elif m > 2:
        order = sorted(range(m), key=lefts.__getitem__)
        place = [0] * m
        for k, x in enumerate(order):
            place[x] = k
        root = list(range(m))
        parts = [[k] for k in place]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for k in sorted(range(1, m), key=lambda k: -lcp[k]):
            x, y, r = find(k - 1), find(k), lcp[k]
            if len(parts[x]) > len(parts[y]):
                x, y = y, x
            small, large = parts[x], parts[y]
            for p in small:
                at = bisect.bisect_left(large, p)
                if at:
                    pair(order[p], order[large[at - 1]], r)
                if at < len(large):
                    pair(order[p], order[large[at]], r)
            large += small
            large.sort()
            parts[x] = []
            root[x] = y
    for ids, ivs in zip(same, met):
        for row, a, o1, o2 in ids:
            if len(ids) > 1:
                yield row, a - o2, a - o1
                continue
            end = o1 - 1
            for lo, hi in sorted(ivs):
                lo, hi = max(lo, end + 1), min(hi, o2)
                if lo <= hi:
                    yield row, a - hi, a - lo
                    end = hi


def cold_windows(docs: DataFrame, kept: DataFrame, parts: int, length: int, run_bytes: int = 32 << 20) -> DataFrame:
    """row, lo, hi: runs of repeated windows at anchors whose grams meet in one task."""

    deal = one_key_each(docs.sparkSession, parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            held.sort()
            # the gram's hash leads the key: the range follows from it
            cuts = [bisect.bisect_left(held, ((p << 64) // parts).to_bytes(9, "big")[1:], key=lambda x: x[0]) for p in range(parts)] + [len(held)]
            runs = [(deal[p], front_code(held[s:e])) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], ["part", "run"]
            )

        size = 0
        for b in batches:
            for right, left, ids, kh in context_rows(b, length):
                held.append(((kh & (1 << 64) - 1).to_bytes(8, "big") + right, left, ids))
                size += len(right) + len(left) + 200
                if size >= run_bytes:
                    yield out()
                    size = 0
        if held:
            yield out()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[int, int, int]] = []

        def out() -> pa.RecordBatch:
            cols = np.array(got, np.int64).T if got else np.zeros((3, 0), np.int64)
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c.astype(np.int32)) for c in cols[1:])], ["row", "lo", "hi"])

        for _, runs in by_part(batches):
            gram: list = []
            for h, key, left, ids in merge(runs):
                if h < 8:
                    if len(gram) > 1:
                        got.extend(settle_gram(gram, length))
                        if len(got) >= 50_000:
                            yield out()
                    gram = []
                gram.append((h - 8, key[8:], left, ids))
            if len(gram) > 1:
                got.extend(settle_gram(gram, length))
        yield out()

    sent = with_anchors(docs, kept).mapInArrow(send, "part int, run binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(receive, "row long, lo int, hi int")


# --- grams too frequent for one task -------------------------------------------------------------------------------

IDS = ["row", "a", "o1", "o2"]
ID_TYPES = "row long, a int, o1 int, o2 int"
def in_portions(rows: Iterator[tuple], kinds: list, names: list[str], most: int = 4000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``most`` rows, so that neither side of the exchange with Python holds many."""
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


SORT_OUT = f"part int, edge int, lcp int, {ID_TYPES}, tie_lcp int, before boolean, key binary, tie binary"


def merge_sort(rows: DataFrame, parts: int, run_rows: int = 10_000, sample: int = 4000) -> DataFrame:
    """Sorts (key, tie, row, a, o1, o2) rows by key, tie and ids over ``parts`` ranges.

    Out, for every row twice at most, once for each neighbour: lcp (common prefix of the keys), tie_lcp (of the ties) and
    before (the neighbour comes before it). The first and last row of a range meet their neighbours in a pass over one pair of rows
    a range. A sample of at most ``sample`` rows, taken by hash, gives the splitters; it bounds what reaches the driver."""
    total = rows.count()
    share = max(1, -(-total // sample))
    picked = (
        rows.filter(F.pmod(F.xxhash64("row", "a", "o1"), F.lit(share)) == 0).select("key", "tie", *IDS).limit(2 * sample).collect()
        if parts > 1 and total
        else []
    )
    order = sorted((bytes(r["key"]), bytes(r["tie"]), tuple(r[n] for n in IDS)) for r in picked)
    cuts = sorted({order[len(order) * k // parts] for k in range(1, parts)}) if order else []

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            held.sort()
            at = [0, *(bisect.bisect_left(held, c) for c in cuts), len(held)]
            runs = [(p, front_code(held[s:e])) for p, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], ["part", "run"]
            )

        held: list = []
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("key", "tie", *IDS)]
            held += zip(cols[0], cols[1], zip(*cols[2:]))
            if len(held) >= run_rows:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, runs in by_part(batches):
            yield from merged(part, runs)

    def merged(part: int, runs: list[Run]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None

        def flush() -> pa.RecordBatch:
            kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.int32()] * 4 + [pa.bool_(), pa.binary(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SORT_OUT.split(", ")])

        for lcp, key, tie, ids in merge(runs):
            if last is None:
                rows.append((part, 1, 0, *ids, 0, True, key, tie))
            elif lcp:
                t = common_prefix(last[0], tie)
                rows.append((part, 0, lcp, *ids, t, True, None, None))
                rows.append((part, 0, lcp, *last[1], t, False, None, None))
            last = tie, ids, key
            if len(rows) >= 8_000:
                yield flush()
        if last:
            rows.append((part, 2, 0, *last[1], 0, False, last[2], last[0]))
        if rows:
            yield flush()

    sent = rows.select("key", "tie", *IDS).mapInArrow(send, "part int, run binary")
    done = materialise(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(receive, SORT_OUT))
    ends = sorted(done.filter("edge > 0").collect(), key=lambda r: (r["part"], r["edge"]))  # two rows for each range
    extra = []
    for x, y in zip(ends[:-1], ends[1:]):
        if x["edge"] == 2 and y["edge"] == 1:
            lcp = common_prefix(bytes(x["key"]), bytes(y["key"]))
            t = common_prefix(bytes(x["tie"]), bytes(y["tie"]))
            extra += [(lcp, t, r is y, *(r[n] for n in IDS)) for r in (x, y) if lcp]
    met = done.filter("edge = 0").select("lcp", "tie_lcp", "before", *IDS)
    if extra:
        met = met.unionByName(rows.sparkSession.createDataFrame(extra, f"lcp int, tie_lcp int, before boolean, {ID_TYPES}"))
    return met


def hot_windows(docs: DataFrame, kept: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """row, lo, hi: runs of repeated windows at anchors of grams of any frequency."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from in_portions(
                ((r, x, *ids, kh) for r, x, ids, kh in context_rows(b, length)),
                [pa.binary()] * 2 + [pa.int64()] + [pa.int32()] * 3 + [pa.int64()], ["right", "left", *IDS, "kh"],
            )

    ctx = materialise(with_anchors(docs, kept).mapInArrow(contexts, f"right binary, left binary, {ID_TYPES}, kh long"))
    by_right = merge_sort(ctx.select(F.col("right").alias("key"), F.col("left").alias("tie"), *IDS), parts)
    key = F.concat(F.substring("right", 1, gram), F.col("left"))
    by_left = merge_sort(ctx.select(key.alias("key"), F.substring("right", gram + 1, length).alias("tie"), *IDS), parts)
    both = by_right.filter(F.col("lcp") >= gram).select(*IDS, "before", F.col("lcp").alias("rext"), F.col("tie_lcp").alias("lext")).unionByName(
        by_left.filter(F.col("lcp") >= gram).select(*IDS, F.lit(False).alias("before"), (F.col("tie_lcp") + gram).alias("rext"), (F.col("lcp") - gram).alias("lext"))
    )
    # window offsets o: repeated with this neighbour for length - rext <= o <= lext
    lo, hi = F.greatest(F.col("o1"), length - F.col("rext")), F.least("o2", "lext")
    both = both.withColumn("iv", F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"))))
    per = materialise(
        both.groupBy(*IDS)
        .agg(F.max("rext").alias("rmax"), F.max("lext").alias("lmax"), F.collect_set("iv").alias("ivs"), F.max(F.when(F.col("before"), F.col("iv"))).alias("prev"))
        .withColumn("ulo", F.greatest(F.col("o1"), length - F.col("rmax")))
        .withColumn("uhi", F.least("o2", "lmax"))
        .withColumn("open", F.when(F.col("ulo") <= F.col("uhi"), F.filter(F.sequence("ulo", "uhi"), lambda o: ~F.exists("ivs", lambda v: (v["lo"] <= o) & (o <= v["hi"])))))
    )
    proven = per.select("row", "a", F.explode("ivs").alias("v")).select("row", (F.col("a") - F.col("v.hi")).alias("lo"), (F.col("a") - F.col("v.lo")).alias("hi"))
    # open: offsets between bound and proof. A row shows its windows at offsets that rows of its gram ask for, but for those
    # that equal the windows of the row before it in right order, which that row or one before it shows
    if not per.filter(F.size("open") > 0).limit(1).count():
        return proven
    keyed = per.filter("ulo <= uhi").join(ctx.select("kh", *IDS), IDS)
    asked = keyed.select("kh", F.explode("open").alias("o")).distinct().groupBy("kh").agg(F.collect_set("o").alias("os"))  # at most ``length`` offsets
    new = F.filter("os", lambda o: (o >= F.col("ulo")) & (o <= F.col("uhi")) & ~F.coalesce((F.col("prev.lo") <= o) & (o <= F.col("prev.hi")), F.lit(False)))
    shown = keyed.join(asked, "kh").select(*IDS, "open", new.alias("os")).filter(F.size("os") > 0)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            for row, a, os, asks, right, left in zip(*(b.column(c).to_pylist() for c in ("row", "a", "os", "open", "right", "left"))):
                back, asks = left[::-1], set(asks)
                for o in os:
                    w = back[len(back) - o :] + right[: length - o]
                    yield row, a - o, o in asks, hashlib.blake2b(w, digest_size=16).digest()

        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                yield from in_portions(rows(b), [pa.int64(), pa.int32(), pa.bool_(), pa.binary()], ["row", "lo", "asks", "w"])

    windows = materialise(shown.join(ctx.drop("kh"), IDS).mapInArrow(digests, "row long, lo int, asks boolean, w binary"))
    again = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    settled = windows.filter("asks").join(again, "w", "left_semi").select("row", "lo", F.col("lo").alias("hi"))
    return proven.unionByName(settled)


def repeated_windows(docs: DataFrame, length: int = 400, gram: int = 32, hot: int = 65_536) -> DataFrame:
    """row, lo, hi: runs of window starts whose ``length`` bytes also start anywhere else in the texts of the numbered rows."""
    found = materialise(anchors(docs, length, gram))
    counts = materialise(found.groupBy("kh").agg(F.count("*").alias("n")).filter("n > 1"))
    # a gram met twice in one slice is known to repeat; only the others look it up, at most one row a slice and gram
    kept = found.filter("multi").unionByName(found.filter("not multi").join(counts.select("kh"), "kh", "left_semi")).drop("multi")
    size = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    parts = max(partitions_for(docs.sparkSession), -(-(size["n"] or 0) // 60_000))
    if (size["most"] or 0) <= hot:
        return cold_windows(docs, kept, parts, length)
    often = counts.filter(F.col("n") > hot).select("kh")
    cold = cold_windows(docs, kept.join(often, "kh", "left_anti"), parts, length)
    return cold.unionByName(hot_windows(docs, kept.join(often, "kh", "left_semi"), parts, length, gram))


def with_runs(rows: DataFrame, row: str, onto: DataFrame | None = None, length: int = 400, **options) -> DataFrame:
    """The numbered rows (or ``onto``, which has their numbers) with one more column, the last: ascending, possibly overlapping runs
    (lo, hi) of bytes repeated in the rows' texts, null if there are none."""
    onto = rows if onto is None else onto
    d = rows.select(F.col(row).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = repeated_windows(d, length, **options).select("row", "lo", (F.col("hi") + length).alias("hi"))
    name = free_name(onto, "_r")
    lists = runs.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias(name)).withColumnRenamed("row", row)
    return onto.join(lists, row, "left")


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 32, hot: int = 65_536) -> DataFrame:
    """doc_id, text, _r: ascending, possibly overlapping runs (lo, hi) of repeated bytes, null if there are none."""
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "row")
    return with_runs(rows, "row", length=length, gram=gram, hot=hot).drop("row")


def _merge_runs(r: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in r or ():
        if out and x["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["hi"])
        else:
            out.append([x["lo"], x["hi"]])
    return [(s, e) for s, e in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return data
    ends = [0, *(e for _, e in spans)]
    starts = [*(s for s, _ in spans), len(data)]
    return b"".join(data[s:e] for s, e in zip(ends, starts))


def substring_dedup(
    docs: DataFrame, length: int = 400, gram: int = 32, with_text: bool = False, hot: int = 65_536, passages: tuple[int, int] | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept: text without bytes of characters cut in two) (, n_passages, passage_bytes).

    ``passages`` (bytes, words) asks for shorter repeats too: runs of at least so many words of whose bytes each lies in a string of so many
    bytes that starts anywhere else. They are counted, not removed."""
    rows = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "row")
    found = with_runs(rows, "row", length=length, gram=gram, hot=hot)
    if passages:
        found = with_runs(rows, "row", found, length=passages[0], gram=gram, hot=hot)
    names = [c for c in found.columns if c not in ("row", "doc_id", "text")]
    longs = ["n_bytes", "n_removed", "n_spans"]
    extra = ["n_passages", "passage_bytes"] if passages else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 4 << 20):
            cols: dict[str, list] = {c: [] for c in (*longs, "kept_sha256", "kept", *extra)}
            lists = [b.column(c).to_pylist() for c in names]
            for k, text in enumerate(b.column("text").to_pylist()):
                data, spans = text.encode(), _merge_runs(lists[0][k])
                left = cut(data, spans)
                row = {"n_bytes": len(data), "n_removed": len(data) - len(left), "n_spans": len(spans), "kept_sha256": hashlib.sha256(left).hexdigest()}
                row["kept"] = left.decode("utf-8", "ignore") if with_text else None
                if passages:
                    whole = [(s, e) for s, e in _merge_runs(lists[1][k]) if len(data[s:e].split()) >= passages[1]]
                    row |= {"n_passages": len(whole), "passage_bytes": sum(e - s for s, e in whole)}
                for c, v in row.items():
                    cols[c].append(v)
            if not with_text:
                del cols["kept"]
            kinds = [pa.string() if c in ("kept_sha256", "kept") else pa.int64() for c in cols]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols.values(), kinds))], ["doc_id", *cols])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = [f"doc_id {kind}", *(f"{c} long" for c in longs), "kept_sha256 string", *(["kept string"] if with_text else []), *(f"{c} long" for c in extra)]
    return found.drop("row").mapInArrow(run, ", ".join(schema))


def cut_repeats(docs: DataFrame, length: int = 400, gram: int = 32, min_words: int = 0, hot: int = 65_536) -> DataFrame:
    """Every row and column of ``docs``, the text without repeated bytes (and without what is left of a character cut in
    two); n_chars, if there, follows the text. Null texts stay null. Runs of fewer than ``min_words`` words stay."""
    row = free_name(docs, "_row")
    joined = with_runs(numbered(docs, row), row, length=length, gram=gram, hot=hot)
    r = joined.columns[-1]

    def without_runs(t: str | None, x) -> str | None:
        if t is None or x is None or not len(x):
            return t
        data = t.encode()
        spans = [(s, e) for s, e in _merge_runs(list(x)) if not min_words or len(data[s:e].split()) >= min_words]
        return cut(data, spans).decode("utf-8", "ignore")

    @F.pandas_udf("string")
    def without(text, runs):
        return text.combine(runs, without_runs)

    new = joined.withColumn("text", F.when(F.col(r).isNull(), F.col("text")).otherwise(without("text", r)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col(r).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return new.select(*docs.columns)
