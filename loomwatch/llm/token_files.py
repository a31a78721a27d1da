"""Token-id files: canonical length-limited Huffman codes with independently decodable blocks.

One code book is made for the whole corpus from global id counts (at most one count per id of the vocabulary
reaches the driver) by package-merge under a limit on the code length, and made canonical, so that the lengths
alone restore it. A segment holds consecutive documents in ascending doc_id order::

    "LWH2" | limit u8 | block u32 | documents u32 | tokens u64 | first position u64 | stream bytes u64
    | checkpoints: one u64 bit offset for each block of ``block`` tokens | tokens of each document u32
    | doc_ids i64 | null flags of the doc_ids u8 | stream: codes, most significant bit first, padded with 8 zero bytes

Each block can be decoded alone from its checkpoint; the reader decodes all blocks of a segment in step through
one table of 2^limit entries. A folder holds the segments (``segments``, one a row) and the code lengths (``book``); it
is all that the reader needs.

Defined results: null or empty text is the end id alone; equal doc_ids stand next to each other, in any order; null
doc_ids come first; a very long text is a segment of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.llm.common import byte_level_encoder, materialise, new_path, partitions_for, text_or_empty, text_slices

MAGIC = b"LWH2"
HEAD = struct.Struct("<4sBIIQQQ")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code length of each id under ``limit`` by package-merge; 0 for ids that never occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate((leaf, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        merged = both[by]
        half = len(merged) // 2
        packages = merged[0 : 2 * half : 2] + merged[1 : 2 * half : 2]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), counting up."""
    codes = np.zeros(len(lengths), np.uint64)
    code = at = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sorted_lengths = lengths[order].astype(int)
    for length in np.unique(sorted_lengths):
        ids = order[sorted_lengths == length]
        code <<= int(length) - at
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
        at = int(length)
    return codes


def decode_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For each ``limit``-bit prefix: id * 32 + code length."""
    codes = canonical_codes(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    entry = order.astype(np.uint32) * 32 + n.astype(np.uint32)
    table = np.repeat(entry, 1 << (limit - n))
    assert not len(order) or codes[order[0]] == 0
    return np.concatenate((table, np.zeros((1 << limit) - len(table), np.uint32)))


def pack_segment(
    ids: np.ndarray, doc_ids: pa.Array, doc_lengths: np.ndarray, first: int, lengths: np.ndarray, codes: np.ndarray, limit: int, block: int
) -> bytes:
    n = lengths[ids].astype(np.int64)
    end = n.cumsum()
    at = end - n
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    words = int(end[-1] >> 5) + 2 if len(end) else 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
    stream = (high + low[:words]).astype(np.uint64).astype(">u4").tobytes() + b"\0" * 8
    head = HEAD.pack(MAGIC, limit, block, len(doc_lengths), len(ids), first, len(stream))
    names = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes()
    return b"".join((head, at[::block].astype("<u8").tobytes(), doc_lengths.astype("<u4").tobytes(), names, nulls, stream))


def unpack_segment(data: bytes, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """(ids, doc_ids, tokens of each document, first position): all blocks decoded in step, each from its checkpoint."""
    magic, limit, block, docs, tokens, first, size = HEAD.unpack_from(data)
    if magic != MAGIC or len(table) != 1 << limit:
        raise ValueError("not a segment of this code book")
    blocks = -(-tokens // block)
    at = HEAD.size
    pos = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
    at += 8 * blocks
    doc_lengths = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    doc_ids = pa.array(np.frombuffer(data, "<i8", docs, at), mask=np.frombuffer(data, "u1", docs, at + 8 * docs).astype(bool))
    stream = np.frombuffer(data, np.uint8, size, at + 9 * docs)
    out = np.empty((block, blocks), np.uint32)
    last = tokens - (blocks - 1) * block if blocks else 0
    shift = np.int64(32 - limit)
    mask = np.int64((1 << limit) - 1)
    s64 = stream.astype(np.int64)
    w32 = (s64[:-3] << 24) | (s64[1:-2] << 16) | (s64[2:-1] << 8) | s64[3:]
    for k in range(block):
        if k == last and blocks:
            pos = pos[:-1]
        if not len(pos):
            break
        got = table[(w32[pos >> 3] >> (shift - (pos & 7))) & mask]
        out[k, : len(pos)] = got >> 5
        pos = pos + (got & 31)
    return out.T.reshape(-1)[:tokens] if blocks else np.zeros(0, np.uint32), doc_ids, doc_lengths, first


def tokenise_sorted(docs: DataFrame, vocab: str, end_id: int, dtype: str) -> DataFrame:
    """Runs of consecutive documents: part, local_start, doc_ids, lengths, ids (bytes of ``dtype``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = byte_level_encoder(vocab, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        part, start = TaskContext.get().partitionId(), 0
        for b in text_slices(batches, 4 << 20):
            coded = encode(b.column("text").to_pylist())
            lengths = [len(x) // width + 1 for x in coded]
            n = sum(lengths)
            row = [[part], [start], [b.column("doc_id").to_pylist()], [lengths], [end.join([*coded, b""])], [n]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "local_start", "doc_ids", "lengths", "ids", "n"])
            start += n

    # rows of one doc_id (or none) are told apart by their number, so that they do not meet in one task
    src = text_or_empty(docs).withColumn("_n", F.monotonically_increasing_id())
    n = partitions_for(docs.sparkSession)
    return src.repartitionByRange(n, "doc_id", "_n").sortWithinPartitions("doc_id").drop("_n").mapInArrow(
        run, "part int, local_start long, doc_ids array<long>, lengths array<int>, ids binary, n long"
    )


def write_token_files(docs: DataFrame, vocab: str, end_id: int = 2, limit: int = 18, block: int = 256, vocab_size: int = 50_257) -> str:
    """Writes code book and segments to a new folder below the shared one and returns its path. ``vocab_size`` bounds what
    reaches the driver."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession)
    size = max(vocab_size, end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    runs = materialise(tokenise_sorted(docs, vocab, end_id, dtype))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in runs.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    base, before = {}, 0  # one number for each partition
    for r in sorted(runs.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        base[r["part"]] = before
        before += r["n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for b in batches:
            for k in range(b.num_rows):
                part = b.column("part")[k].as_py()
                first = base[part] + b.column("local_start")[k].as_py()
                ids = np.frombuffer(b.column("ids")[k].as_buffer(), dtype)
                docs_n = b.column("lengths")[k].values.to_numpy()
                data = pack_segment(ids, b.column("doc_ids")[k].values, docs_n, first, lengths, codes, limit, block)
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([data], pa.binary())], ["first", "segment"])

    some = [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)]
    spark.createDataFrame(some, "id int, bits int").coalesce(1).write.parquet(f"{path}/book")
    runs.mapInArrow(pack, "first long, segment binary").write.option("compression", "uncompressed").parquet(f"{path}/segments")
    return path


def read_token_files(spark: SparkSession, path: str, limit: int = 18, with_ids: bool = False) -> DataFrame:
    """Per document, from the folder alone: doc_id, start, n_tokens, ids_crc32 (, ids)."""
    book = spark.read.schema("id int, bits int").parquet(f"{path}/book").collect()  # one row for each id of the vocabulary at most
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, limit)
        for b in batches:
            for k in range(b.num_rows):
                ids, doc_ids, sizes, first = unpack_segment(b.column("segment")[k].as_buffer().to_pybytes(), table)
                ids = ids.astype("<u4")
                ends = sizes.astype(np.int64).cumsum()
                starts = ends - sizes
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                cols = [doc_ids, pa.array(starts + first), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[s:e].astype("i4") for s, e in zip(starts, ends)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.read.schema("first long, segment binary").parquet(f"{path}/segments").select("segment")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
