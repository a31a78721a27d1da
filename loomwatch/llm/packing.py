"""Vector best-fit packing of tokenised documents into fixed-length sequences.

A piece has three demands: its tokens, one document, and its attention cost (length squared). A bin has a
capacity for each. Because every demand follows from the length, bins in the same state are interchangeable
and so are pieces of one length: the planner works on the histogram of lengths (at most ``max_tokens``
entries, whatever the corpus) and on groups of bins in equal state. Lengths go from long to short; of the bin
groups that satisfy *every* constraint the one with the best score is filled first. ``score`` is ``dot`` (the
weighted dot product of the piece's demand and the bin's residual, both as shares of capacity; the smallest
product is the tightest fit) or ``norm`` (the smallest weighted norm of what would be left).

With the default capacities (as many documents as tokens, the cost of one full piece) only tokens can bind: the squares of lengths
that add up to ``max_tokens`` never exceed its square. A cap on documents, or a smaller cost where pieces are shorter, binds.

Pieces meet their slots by rank within their length. The rank is counted in salted shards (length, shard) with
shard offsets, whose number follows from the row count, so that a length held by a third of all rows does not meet in one task.

Defined results: null or empty text is one piece that holds the end id alone; equal lengths are placed in
(shard, doc_id, piece) order; repeated rows are pieces of their own; a very long text is cut into as many pieces as it needs; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loomwatch.llm.common import materialise, text_or_empty, text_slices, word_encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise_pieces(docs: DataFrame, vocab: str, end_id: int = 1, max_tokens: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids per document; ``with_ids`` adds the ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(vocab), np.array([end_id], "<u4").tobytes()
        for b in text_slices(batches, 4 << 20):
            doc, no, start, length, crc, kept = [], [], [], [], [], []
            for d, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist())):
                a = np.frombuffer(ids + end, "<u4")
                for k, s in enumerate(range(0, len(a), max_tokens)):
                    part = a[s : s + max_tokens]
                    doc.append(d)
                    no.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part.astype("i4"))
            cols = [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return text_or_empty(docs).mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def plan_bins(
    histogram: dict[int, int],
    max_tokens: int = 4096,
    max_docs: int | None = None,
    max_cost: int | None = None,
    score: str = "dot",
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first_rank, count, first_bin, per_bin, offset) and the number of bins.

    Pieces of ``length`` ranked first_rank .. first_rank+count-1 fill bins first_bin, first_bin+1, ... with
    ``per_bin`` pieces each, the first of a bin at ``offset``. One run covers any number of bins.
    """
    docs_cap = max_docs or max_tokens
    cost_cap = max_cost or max_tokens * max_tokens
    cap = np.array([max_tokens, docs_cap, cost_cap], float)
    wt = np.array(weights)
    if score not in ("dot", "norm"):
        raise ValueError(score)
    # groups of bins in one state: used tokens, documents, cost; first bin, bins
    state, at = np.zeros((64, 5), np.int64), 0
    runs, bins = [], 0

    def add(group: tuple[int, ...]) -> None:
        nonlocal state, at
        if at == len(state):
            state = np.concatenate((state, np.zeros_like(state)))
        state[at] = group
        at += 1

    for length in sorted(histogram, reverse=True):
        left, rank, cost = histogram[length], 0, length * length
        if length > max_tokens or cost > cost_cap:
            raise ValueError(f"a piece of {length} tokens exceeds an empty bin")
        need = np.array([length, 1, cost], float) / cap
        while left:
            room = (cap - state[:at, :3]) / cap
            fits = np.flatnonzero((room >= need - 1e-12).all(axis=1))
            if not len(fits):  # as many new bins as the remaining pieces of this length need
                per = min(max_tokens // length, docs_cap, cost_cap // cost)
                n = -(-left // per)
                add((0, 0, 0, bins, n))
                bins += n
                continue
            room = room[fits]
            s = (room * need * wt).sum(axis=1) if score == "dot" else (((room - need) ** 2) * wt).sum(axis=1)
            best = int(fits[s.argmin()])
            used, docs, spent, first, n = state[best].tolist()
            per = min((max_tokens - used) // length, docs_cap - docs, (cost_cap - spent) // cost)
            if left >= per * n:
                filled, take = n, per
            elif left >= per:
                filled, take = left // per, per
            else:
                filled, take = 1, left
            runs.append((length, rank, filled * take, first, take, used))
            rank += filled * take
            left -= filled * take
            if filled == n:
                at -= 1
                state[best] = state[at]
            else:
                state[best] = used, docs, spent, first + filled, n - filled
            after = used + take * length, docs + take, spent + take * cost, first, filled
            if after[0] < max_tokens and after[1] < docs_cap and after[2] < cost_cap:
                add(after)
    return runs, bins


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, max_docs: int | None = None, max_cost: int | None = None,
                score: str = "dot", shard_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...). The input is materialised once. A length is ranked in as many
    shards as hold about ``shard_rows`` pieces each if all pieces had that length."""
    spark = pieces.sparkSession
    p = materialise(pieces)
    shards = -(-max(1, p.count()) // shard_rows)
    p = p.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    counts = p.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    # at most max_tokens rows reach the driver, whatever the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan_bins(histogram, max_tokens, max_docs, max_cost, score)
    base = counts.withColumn(
        "_base", F.sum("_n").over(W.partitionBy("length").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1))
    ).select("length", "_shard", F.coalesce("_base", F.lit(0)).alias("_base"))
    by_length: dict[int, list] = {}
    for length, first, n, bin_, per, off in runs:
        by_length.setdefault(length, []).append((first, n, bin_, per, off))
    plan = spark.createDataFrame(
        [(k, v) for k, v in sorted(by_length.items())],
        "length long, _runs array<struct<first:long,n:long,bin:long,per:long,off:long>>",
    )
    slot = F.row_number().over(W.partitionBy("length", "_shard").orderBy("doc_id", "piece")) - 1
    ranked = (
        p.withColumn("_slot", slot)
        .join(base, ["length", "_shard"])
        .withColumn("_rank", F.col("_base") + F.col("_slot"))
        .join(plan, "length")
    )
    run = F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["n"]))[0]
    at = F.col("_rank") - F.col("_run.first")
    return (
        ranked.withColumn("_run", run)
        .withColumn("sequence_id", (F.col("_run.bin") + F.floor(at / F.col("_run.per"))).cast("long"))
        .withColumn("offset", (F.col("_run.off") + (at % F.col("_run.per")) * F.col("length")).cast("long"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 1, max_tokens: int = 4096, with_ids: bool = False,
                   max_docs: int | None = None, max_cost: int | None = None, score: str = "dot") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    pieces = tokenise_pieces(docs, vocab, end_id, max_tokens, with_ids)
    return pack_pieces(pieces, max_tokens, max_docs, max_cost, score)
