"""Log files by byte ranges: the source ``log_lines``, for batch and streams. It reads by pyarrow's file systems (local or shared folders, HDFS, object
stores), decodes every file by the encoding of its first bytes, and in a stream follows files that grow, are cut off or replaced."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file that decide its encoding.
HEAD = 65_536
#: Bytes of one split; a line belongs to the split in which it begins.
SPLIT = 64 << 20
CHUNK = 1 << 20
SCHEMA = "run_id string, encoding string, block long, k long, pos long, raw string"
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def encoding_of(head: bytes) -> str:
    """By mark, share of NUL bytes, then the first of UTF-8 and Windows-1252 that decodes; else Latin-1."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    if head and head.count(0) > len(head) // 5:
        return "utf-16le" if head[1::2].count(0) > head[0::2].count(0) else "utf-16be"
    for name, codec in (("utf-8", "utf-8"), ("windows-1252", "cp1252")):
        for cut in range(4 if len(head) >= HEAD else 1):  # a full head may end inside a character
            try:
                head[: len(head) - cut].decode(codec)
                return name
            except UnicodeDecodeError:
                continue
    return "iso-8859-1"


def _open(uri: str):
    if uri.startswith("file:"):  # Spark writes file:/a as well as file:///a
        return files.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return files.FileSystem.from_uri(uri) if "://" in uri else (files.LocalFileSystem(), uri)


def head(uri: str) -> bytes:
    fs, path = _open(unquote(uri))
    with fs.open_input_file(path) as f:
        return f.read(HEAD)


def listed(uri: str) -> dict[str, int]:
    """Path -> bytes of the files below a folder, or of the one file; names that begin with a dot or an underscore are left out."""
    fs, path = _open(uri)
    one = fs.get_file_info(path)
    if one.type == files.FileType.File:
        return {one.path: one.size}
    if one.type == files.FileType.NotFound:
        return {}
    found = fs.get_file_info(files.FileSelector(path, recursive=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == files.FileType.File and f.base_name[:1] not in "._"}


def _unit(encoding: str) -> np.dtype:
    return np.dtype({"utf-16le": "<u2", "utf-16be": ">u2"}.get(encoding, "u1"))


def _breaks(raw: bytes, unit: np.dtype) -> list[int]:
    """Where lines end: the byte after each line feed. ``raw`` begins at a whole unit."""
    whole = len(raw) // unit.itemsize
    return ((np.flatnonzero(np.frombuffer(raw, unit, whole) == 10) + 1) * unit.itemsize).tolist()


def _lines(f, lo: int, hi: int, unit: np.dtype) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes with the line feed) of the lines that begin in [lo, hi)."""
    at = max(0, lo - unit.itemsize) if lo else 0  # a line that begins at lo has its line feed before it
    skip = lo > 0
    f.seek(at)
    held: list[bytes] = []
    begin = at
    while True:
        raw = f.read(CHUNK)
        last = 0
        for cut in _breaks(raw, unit):
            line = b"".join(held) + raw[last:cut]
            if skip:
                skip = False
            elif begin >= hi:
                return
            else:
                yield begin, line
            held, last, begin = [], cut, at + cut
        if len(raw) < CHUNK:
            line = b"".join(held) + raw[last:]
            if line and not skip and begin < hi:
                yield begin, line
            return
        if begin >= hi and not skip:
            return
        held.append(raw[last:])
        at += len(raw)


@dataclass
class Split(InputPartition):
    """Lines of one file that begin in [lo, hi)."""

    path: str
    lo: int
    hi: int


def _read(uri: str, split: Split) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(uri)
    with fs.open_input_file(split.path) as f:
        encoding = encoding_of(f.read(HEAD))
        unit, codec = _unit(encoding), {"windows-1252": "cp1252"}.get(encoding, encoding)
        pos: list[int] = []
        raw: list[str] = []
        size = k = 0

        def batch() -> pa.RecordBatch:
            n = len(pos)
            cols = [pa.array([split.path] * n), pa.array([encoding] * n), pa.array([split.lo] * n, pa.int64()), pa.array(range(k - n, k), pa.int64()), pa.array(pos, pa.int64()), pa.array(raw, pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["run_id", "encoding", "block", "k", "pos", "raw"])

        for begin, line in _lines(f, split.lo, split.hi, unit):
            text = line.decode(codec, "replace").removesuffix("\n").removesuffix("\r")
            pos.append(begin)
            raw.append(text.removeprefix("﻿") if begin == 0 else text)
            k, size = k + 1, size + len(line)
            if size > CHUNK:
                yield batch()
                pos, raw, size = [], [], 0
        if pos:
            yield batch()


def _splits(path: str, lo: int, hi: int, size: int) -> list[Split]:
    return [Split(path, s, min(hi, s + size)) for s in range(lo, hi, size)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT)) // 2 * 2

    def partitions(self) -> list[Split]:
        return [s for p, n in listed(self.path).items() for s in _splits(p, 0, n, self.size)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are {path: [bytes of whole lines, check of the first line]}. A file whose end went back, or whose first line is another, is read from its
    start; all else is read from where the last batch ended. Both follow from the offsets alone, so that a restarted query decides alike."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT)) // 2 * 2

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = _open(self.path)
        return {p: _whole(fs, p, n) for p, n in listed(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out: list[Split] = []
        for path, (stop, check) in end.items():
            done, before = start.get(path, (0, check))
            out += _splits(path, done if check == before and stop >= done else 0, stop, self.size)
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


def _whole(fs, path: str, size: int) -> list[int]:
    """Bytes up to the last line feed, and a check of the first line (of its first HEAD bytes); [0, 0] while no line is whole."""
    with fs.open_input_file(path) as f:
        head = f.read(HEAD)
        unit = _unit(encoding_of(head))
        first = _breaks(head, unit)
        stop = size // unit.itemsize * unit.itemsize
        while stop > 0:
            lo = max(0, stop - HEAD)
            f.seek(lo)
            cuts = _breaks(f.read(stop - lo), unit)
            if cuts:
                return [lo + cuts[-1], zlib.crc32(head[: first[0]] if first else head)]
            stop = lo
    return [0, 0]


class LogLines(DataSource):
    """``spark.read.format("log_lines").load(folder)`` and ``readStream`` alike. Rows: run_id (the file), encoding, block (first byte of the split), k (place
    in it, from 0), pos (first byte of the line), raw. A stream waits for a line's line feed; a batch takes a last line without one."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def decoded_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(run_id, encoding, n, raw): like ``numbered_lines``, each file by its own encoding. Of a file, only one count a split is summed up."""
    spark.dataSource.register(LogLines)
    d = spark.read.format("log_lines").option("splitBytes", split_bytes).load(path)
    w = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy("run_id", "block").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    return d.join(before, ["run_id", "block"]).select("run_id", "encoding", (F.col("k") + F.col("_before") + 1).alias("n"), "raw")


def followed_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(run_id, encoding, n, raw) as a stream: every line once, n its first byte (it orders the lines of a file); a file that was cut off or replaced starts
    over. A file that is replaced by a longer one with the same first line is taken for grown."""
    spark.dataSource.register(LogLines)
    d = spark.readStream.format("log_lines").option("splitBytes", split_bytes).load(path)
    return d.select("run_id", "encoding", F.col("pos").alias("n"), "raw")
