"""Near duplicates by word-shingle Jaccard similarity: MinHash LSH forest, then exact verification.

1. Texts with equal sets of five-word shingles form a class; only its first row goes on.
2. Every class gets L trees of MinHash prefixes. A forest matches on the longest prefixes first and shortens them
   until the expected recall at the threshold reaches the target: a pair of similarity s is met at depth d with
   probability 1 - (1 - s^d)^L, so the depth is the largest d whose recall still reaches the target, and all
   longer matches are among those. Buckets with the same members in several trees are compared once.
3. In a bucket (large ones in blocks) full signatures are compared; pairs whose estimated similarity is well below
   the threshold (by seven standard deviations) are dropped. Only a spanning star per component leaves the task.
4. Candidate components are completed on Spark; within each (large ones in blocks) the exact Jaccard
   similarity of every pair is taken from whole shingle sets. What leaves a task is a count of links for each class
   and a spanning star, so that rows grow with documents, not pairs.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered; shingles are kept as 64-bit hashes.

Defined results: null counts as empty; a text without words has no shingles, links with nothing and is its own
class; a text of one to four words has one shingle, all its words; equal texts are linked; a tie goes to the
smallest doc_id (null last), then to the first row; rows are told apart by a number of their own, so rows of a repeated or null
doc_id are compared like any others and exactly one row of a class is kept; an empty table gives no rows; extra columns are ignored (``near_duplicates``) or passed through (``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.common import materialise, text_slices, with_rows
from loomwatch.llm.graph import connected_components, spanning_edges
from loomwatch.llm.groups import in_blocks, map_groups
from loomwatch.llm.words import mix, shingle_sets, text_bytes


def depth_for(threshold: float, trees: int, recall: float, deepest: int = 16) -> int:
    """The longest prefix at which pairs at the threshold are still met with the wanted probability."""
    for d in range(deepest, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("too few trees for this recall")


def signatures(docs: DataFrame, size: int, trees: int, depth: int, seed: int) -> DataFrame:
    """doc_id, row, n (distinct shingles), h1, h2 (of the set), keys (one bucket per tree), sig (bytes of uint32)."""
    width = trees * depth
    rng = np.random.default_rng(seed)
    mul = (rng.integers(0, 1 << 32, width, dtype=np.uint64) | 1).astype(np.uint32)
    add = rng.integers(0, 1 << 32, width, dtype=np.uint64).astype(np.uint32)
    tree_salt = mix(np.arange(1, trees + 1, dtype=np.uint64))
    weight = mix(np.arange(1, depth + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2 << 20):
            bounds, h = shingle_sets(*text_bytes(b.column("text")), size)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            sig = np.full((b.num_rows, width), 0xFFFFFFFF, np.uint32)
            h1, h2 = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            if len(some):
                at, x = bounds[:-1][some], (h >> np.uint64(32)).astype(np.uint32)
                for k in range(width):
                    sig[some, k] = np.minimum.reduceat(x * mul[k] + add[k], at)
                h1[some] = np.add.reduceat(mix(h), at)
                h2[some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
            prefix = sig.reshape(-1, trees, depth).astype(np.uint64)
            keys = mix((mix(prefix + np.uint64(1)) * weight).sum(axis=2, dtype=np.uint64) ^ tree_salt).view(np.int64)
            flat = pa.array(keys.reshape(-1))
            rows = np.arange(b.num_rows + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("row"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(rows * trees, pa.int32()), flat),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                ["doc_id", "row", "n", "h1", "h2", "keys", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, row long, n long, h1 long, h2 long, keys array<long>, sig binary")


def shingles_of(docs: DataFrame, size: int) -> DataFrame:
    """row, set (bytes of sorted uint64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2 << 20):
            bounds, h = shingle_sets(*text_bytes(b.column("text")), size)
            sets = [h[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sets, pa.binary())], ["row", "set"])

    return docs.mapInArrow(run, "row long, set binary")


def _sides(t: pa.Table) -> tuple[np.ndarray, int, int]:
    return t["_mine"].to_numpy(), t["_i"][0].as_py(), t["_j"][0].as_py()


def _pairs_allowed(mine: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs (row < column) that this block pair is answerable for."""
    m = len(mine)
    ok = np.triu(np.ones((m, m), bool), 1)
    return ok if i == j else ok & (mine[:, None] != mine[None, :])


def _estimate(least: float):
    def fn(t: pa.Table):
        if t.num_rows < 2:
            return None
        mine, i, j = _sides(t)
        rep = t["rep"].to_numpy()
        sig = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in t["sig"]])
        if len(rep) == 2:
            near = (sig[0] == sig[1]).mean() >= least
            return (rep[1:], rep[:1]) if near else None
        left, right = [], []
        for r in range(len(rep) - 1):
            same = (sig[r + 1 :] == sig[r]).mean(axis=1) >= least
            if i != j:
                same &= mine[r + 1 :] != mine[r]
            hit = np.flatnonzero(same) + r + 1
            left.append(np.full(len(hit), r))
            right.append(hit)
        a, b = spanning_edges(len(rep), np.concatenate(left), np.concatenate(right))
        return rep[a], rep[b]

    return fn


def exact_links(sets: list[np.ndarray], allowed: np.ndarray, threshold: float, columns: int = 8192) -> np.ndarray:
    """Boolean matrix of the allowed pairs whose exact Jaccard similarity reaches the threshold."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m <= 4:
        inter = np.zeros((m, m))
        for a in range(m):
            for b in range(a + 1, m):
                inter[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        words, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), n)
        shared = count[col] > 1
        new = np.cumsum(count > 1) - 1
        row, col = row[shared], new[col[shared]]
        inter = np.zeros((m, m), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int((count > 1).sum()), columns):
            s, e = np.searchsorted(col, (lo, lo + columns))
            x = np.zeros((m, min(columns, int((count > 1).sum()) - lo)), np.float32)
            x[row[s:e], col[s:e] - lo] = 1
            inter += x @ x.T
    union = n[:, None] + n[None, :] - inter
    return allowed & (union > 0) & (inter >= threshold * union - 1e-9)


def _verify(threshold: float):
    def fn(t: pa.Table):
        if t.num_rows < 2:
            return None
        mine, i, j = _sides(t)
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["set"]]
        link = exact_links(sets, _pairs_allowed(mine, i, j), threshold)
        a, b = np.nonzero(link)
        if not len(a):
            return None
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = rep.copy()  # itself: no edge
        s, r = spanning_edges(len(rep), a, b)
        root[s] = rep[r]
        some = np.flatnonzero(links)
        return rep[some], links[some], root[some]

    return fn


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 32, recall: float = 0.9999, seed: int = 7,
    block: int = 512,
) -> DataFrame:
    """One row per row: doc_id, class_id (smallest doc_id reachable by links), n_links, n_copies, kept."""
    rows, row = with_rows(docs.select("doc_id", "text"))
    return verdicts(rows, row, threshold, size, trees, recall, seed, block).drop("row")


def verdicts(
    rows: DataFrame, row: str, threshold: float = 0.8, size: int = 5, trees: int = 32, recall: float = 0.9999, seed: int = 7,
    block: int = 512,
) -> DataFrame:
    """The rows of ``near_duplicates`` with their number, named ``row``, which the written ``rows`` hold in the column ``row``."""
    docs = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(row).alias("row"))
    depth = depth_for(threshold, trees, recall)
    sig = materialise(signatures(docs, size, trees, depth, seed))
    has = sig.filter("n > 0")
    same = ["n", "h1", "h2"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    classes = materialise(has.groupBy(*same).agg(F.min("row").alias("rep"), best, F.count("*").alias("copies")))
    one = sig.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    buckets = one.select(F.col("row").alias("rep"), F.explode("keys").alias("key"))
    held = buckets.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")).filter("m > 1")
    held = held.groupBy("m", "members").agg(F.min("key").alias("key"))
    cand = buckets.join(held.select("key", "m"), "key").join(one.select(F.col("row").alias("rep"), "sig"), "rep")
    deviation = (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    near = map_groups(
        in_blocks(cand, ["key"], "m", "rep", block), ["key", "_i", "_j"], _estimate(max(0.0, threshold - 7 * deviation)), "a long, b long"
    )
    comp = materialise(connected_components(near))
    counted = comp.groupBy("component").agg(F.count("*").alias("m"))
    wanted = comp.join(counted, "component").join(classes.select(F.col("rep").alias("id"), "copies"), "id")
    texts = docs.join(comp.select(F.col("id").alias("row")), "row", "left_semi")
    sets = shingles_of(texts, size).join(wanted.withColumnRenamed("id", "row"), "row").withColumnRenamed("row", "rep")
    found = materialise(
        map_groups(in_blocks(sets, ["component"], "m", "rep", block), ["component", "_i", "_j"], _verify(threshold), "rep long, links long, root long")
    )
    final = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = final.select(F.col("id").alias("rep"), "component")
    heads = classes.join(member, "rep").groupBy("component").agg(F.min("best").alias("head"))
    by_class = (
        classes.join(links, "rep", "left")
        .join(member.join(heads, "component").select("rep", "head"), "rep", "left")
        .select(*same, F.coalesce("head", "best").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    )
    return sig.select("doc_id", "row", *same).join(by_class, same, "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("kept"),
        "row",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` of each near-duplicate class, that of the smallest doc_id, with all its columns."""
    rows, row = with_rows(docs)
    gone = verdicts(rows, row, **options).filter("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
