"""Merkle manifest of a dataset by time-forward processing: roots, and a proof of every row that is folded back to the root.

A row's leaf is the digest of its fields. Per group (source) the leaves ascend; while several nodes remain, every ``ARITY``
consecutive ones become the digest of their hex digests, and what remains is the group's root. Group roots, in the groups' order, give
the dataset's root by the same rule.

Nodes are labelled (level, index). Children send their digests to their parent's label through a priority queue, and parents are worked off in
the order of labels. The queue is external: between blocks of ``ARITY ** LEVELS`` consecutive nodes it is Spark's sorted, spilling
shuffle, keyed by (group, block); within a block it is a heap. A round climbs ``LEVELS`` levels, so 10^11 rows take five rounds, each a
243rd of the one before, and a group of any size is spread over its blocks. The sweep back meets the same blocks in reverse order: a
block's header brings the proof suffix of its top node, and a queue in descending labels hands suffixes down to the leaves. Only
the root itself reaches the driver.

Positions come from a range partition of (group, order, leaf) with counts of each partition, so no group is ordered in one task.

Defined results: a null field is ``-``; null groups are one group, the first; rows of equal (or null) order stand in the order of their
leaves; repeated rows are leaves of their own; a lone leaf is its group's root, a lone group's root the dataset's; a leaf without siblings
anywhere has the digest of nothing as its proof; a text of any length is digested in the JVM; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwatch.llm.common import materialise, partitions_for

ARITY = 3
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "gid long, idx long, n long, digest binary"


def digest_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for a null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The leaf digest (binary) of a row; ``changed`` gives other values for some fields."""
    return F.unhex(F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256))


def leaves(docs: DataFrame, tampered: Column | None = None, altered: Column | None = None) -> DataFrame:
    """Narrow rows (doc_id, grp, ord, digest, alt): the leaf, and where ``tampered`` holds the leaf of the row with ``altered`` for its text."""
    alt = F.when(tampered, leaf(text=altered)) if tampered is not None else F.lit(None).cast("binary")
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.select(F.col("doc_id"), group.alias("grp"), F.col("doc_id").alias("ord"), leaf().alias("digest"), alt.alias("alt"))


def in_order(rows: DataFrame) -> DataFrame:
    """Adds gid (ascends as grp does), idx (from 0 within the group, by ord and digest) and n (the group's size); grp and ord go."""
    spark = rows.sparkSession
    held = materialise(rows.withColumn("_tie", F.monotonically_increasing_id()))  # the sampling for ranges does not digest texts again
    keys = ["grp", "ord", "digest", "_tie"]  # the tie spreads even a third of all rows that are one row
    ranged = held.repartitionByRange(partitions_for(spark), *keys).sortWithinPartitions(*keys)
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_tie", "ord"))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    over = W.partitionBy("grp")  # one row for each partition that the group touches
    counts = counts.select(
        "grp", "_part", "_first", F.min("_first").over(over).alias("gid"), F.sum("_rows").over(over).alias("n"),
        F.coalesce(F.sum("_rows").over(over.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    own = placed.withColumn("_part", part).join(counts, ["grp", "_part"])
    return own.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("grp", "_part", "_at", "_first", "_before")


def climbs(nodes: int, most: int = LEVELS) -> int:
    """Levels that a group of ``nodes`` climbs in one round."""
    up = 0
    while nodes > 1 and up < most:
        nodes, up = -(-nodes // ARITY), up + 1
    return up


def forward(first: int, digests: list[str], levels: int) -> tuple[str, list[tuple[int, list[str]]]]:
    """One block: nodes first, first + 1, ... of level 0 deliver to their parents until one node of level ``levels`` is left. Returns its digest and
    the runs, as (label of the first child, digests), in the order of labels."""
    queue = [(first + k, d) for k, d in enumerate(digests)]  # ascending, so a heap
    runs: list[tuple[int, list[str]]] = []
    top = levels << 56
    while queue[0][0] < top:
        at, d = heapq.heappop(queue)
        level, index = at >> 56, at & (1 << 56) - 1
        run, end = [d], (level << 56) + index - index % ARITY + ARITY
        while queue and queue[0][0] < end:
            run.append(heapq.heappop(queue)[1])
        runs.append((at, run))
        heapq.heappush(queue, (((level + 1) << 56) + index // ARITY, digest_hex("".join(run))))
    return queue[0][1], runs


def backward(runs: list[tuple[int, list[str]]], levels: int, top: int, suffix: tuple[bytes, str]) -> list[tuple[bytes, str]]:
    """Suffixes (shape, siblings) of the block's level-0 nodes, in order: each parent hands its own to its children, which put their siblings
    before it. A shape has one byte a level: position * 4 + size of the run."""
    queue = [(-((levels << 56) + top), suffix)]
    out: list[tuple[bytes, str]] = []
    for at, run in reversed(runs):
        level, index = at >> 56, at & (1 << 56) - 1
        label, (shape, above) = heapq.heappop(queue)
        assert -label == ((level + 1) << 56) + index // ARITY
        for k in range(len(run) - 1, -1, -1):
            own = bytes((k * 4 + len(run),)) + shape, "".join(run[:k] + run[k + 1 :]) + above
            if level:
                heapq.heappush(queue, (-(at + k), own))
            else:
                out.append(own)
    return out[::-1] if runs else [suffix]


def fold(digest: str, shape: bytes, siblings: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for x in shape:
        place, size = x >> 2, x & 3
        mid, end = at + 64 * place, at + 64 * (size - 1)
        digest = digest_hex(siblings[at:mid] + digest + siblings[mid:end])
        at = end
    return digest


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """(header, nodes) of one (gid, blk) at a time, from batches sorted by it; without headers an empty dict."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (held[0]["gid"], held[0]["blk"]) != (row["gid"], row["blk"]):
                yield (held[0], held[1:]) if held[0]["idx"] < 0 else ({}, held)
                held = []
            held.append(row)
    if held:
        yield (held[0], held[1:]) if held[0]["idx"] < 0 else ({}, held)


def delivered(nodes: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """What the external queue delivers: nodes by block, in order, each block behind its header (idx -1)."""
    rows = nodes.withColumn("blk", F.expr(f"idx div {ARITY**LEVELS}"))
    if headers is not None:
        rows = rows.unionByName(headers.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition(partitions_for(rows.sparkSession), "gid", "blk").sortWithinPartitions("gid", "blk", "idx")


def climb(nodes: DataFrame) -> DataFrame:
    """One round: the top node of every block; n is how many nodes of its group are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in blocks(batches):
            left = rows[0]["n"]
            up = climbs(left)
            digest, _ = forward(rows[0]["idx"], [r["digest"].hex() for r in rows], up)
            out.append((rows[0]["gid"], rows[0]["blk"], -(-left // ARITY**up), bytes.fromhex(digest)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], ["gid", "idx", "n", "digest"])

    return materialise(delivered(nodes.select("gid", "idx", "n", "digest")).mapInArrow(run, NODE))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node tables of all rounds, leaves first, and the groups' roots (gid, digest)."""
    rounds, tops = [nodes], None
    while True:
        up = climb(rounds[-1])
        done = up.filter("n = 1").select("gid", "digest")
        tops = done if tops is None else tops.unionByName(done)
        rest = up.filter("n > 1")
        if rest.isEmpty():
            return rounds, tops
        rounds.append(rest)


HEADER = "gid long, blk long, shape binary, siblings string, root binary"


def hand_down(nodes: DataFrame, headers: DataFrame, to_groups: bool = False) -> DataFrame:
    """Suffixes of the nodes of one round, from the headers of their blocks, as headers of the blocks below: a node's block has the node's index.
    ``to_groups``: the nodes are group roots, and each one's suffix heads the only block of the group ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rows in blocks(batches):
            to = [(r["of"], 0, r["digest"]) if to_groups else (r["gid"], r["idx"], head["root"]) for r in rows]
            out = [(g, b, *s, root) for (g, b, root), s in zip(to, suffixes(head, rows))]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["gid", "blk", "shape", "siblings", "root"])

    return materialise(delivered(nodes, headers).mapInArrow(run, HEADER))


def suffixes(head: dict, rows: list[dict]) -> list[tuple[bytes, str]]:
    up = climbs(rows[0]["n"])
    _, runs = forward(rows[0]["idx"], [r["digest"].hex() for r in rows], up)
    return backward(runs, up, rows[0]["idx"] // ARITY**up, (head["shape"], head["siblings"]))


def manifest(docs: DataFrame, tampered: Column | None = None, altered: Column | None = None, with_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; ``with_proof`` adds the proof itself: shape (one byte a level)
    and siblings (hex digests), for ``fold``. Where ``tampered`` holds, the leaf that is folded is that of the row with ``altered`` as its text."""
    rows = materialise(in_order(leaves(docs, tampered, altered)))
    rounds, tops = build(rows.select("gid", "idx", "n", "digest"))
    groups = materialise(in_order(tops.select(F.lit("").alias("grp"), F.col("gid").alias("ord"), "digest", F.col("gid").alias("of"))))
    over, top = build(groups)
    found = top.collect()  # the root: one row, or none where there are no rows
    root_hex = found[0]["digest"].hex() if found else ""
    heads = top.select("gid", F.lit(0).cast("long").alias("blk"), F.lit(b"").alias("shape"), F.lit("").alias("siblings"), F.col("digest").alias("root"))
    for nodes in over[:0:-1]:
        heads = hand_down(nodes, heads)
    of_groups = hand_down(groups, heads, to_groups=True)
    heads = None
    for k in range(len(rounds) - 1, -1, -1):
        # a group whose climb ended in this round is one block, and takes its group's header; the others' come from the round above
        ended = rounds[k].filter((F.col("idx") == 0) & (F.col("n") <= ARITY**LEVELS)).select("gid")
        own = of_groups.join(ended, "gid", "left_semi")
        heads = own if heads is None else own.unionByName(hand_down(rounds[k + 1], heads))

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["shape", "siblings"] * with_proof
    id_type = docs.schema["doc_id"].dataType
    kinds = [to_arrow_type(id_type), *[pa.string()] * 5, pa.bool_()] + [pa.binary(), pa.string()] * with_proof

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, block in blocks(batches):
            subroot, out = head["root"].hex(), []
            for r, (shape, siblings) in zip(block, suffixes(head, block)):
                own = r["digest"].hex()
                folded = fold(own if r["alt"] is None else r["alt"].hex(), shape, siblings)
                row = r["doc_id"], own, subroot, root_hex, digest_hex(siblings), folded, folded == root_hex
                out.append(row + (shape, siblings) if with_proof else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = f"doc_id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return delivered(rows, heads).mapInArrow(prove, schema + (", shape binary, siblings string" if with_proof else ""))
