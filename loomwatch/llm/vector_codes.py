"""Vector code compression: product codes from integer codebooks, with nearest entries found through memoised grid cells.

A component x becomes floor(256 x). A vector is cut into ``parts`` equal parts, each with a codebook of its own that starts as that part of the
smallest vec_ids and is moved by a few rounds of assignment and floored means. A code is the index of each part's nearest entry.

A part is looked up by its coarse cell, an aligned box of ``1 << shift`` integers a side. The first time that a task meets a cell, every entry's least
and greatest distance over the box is worked out, and the entries that another one dominates (least distance above the smallest
greatest distance) are left out for good. Parts of a known cell are held against its few entries only, exactly, in integers.

Spark holds the vectors: each round is one pass in which tasks emit one sum for each (part, entry) that they met, at most ``parts * entries`` rows a
task, merged by key. Codebooks (``entries`` vectors) are all that reaches the driver and is sent to tasks; their size is that of 64 vectors.

Defined results: vectors that are null or hold null or non-finite components are dropped; equal vec_ids are ordered by their vectors, null
vec_ids come last; with fewer vectors than entries the codebooks are smaller; a length that ``parts`` does not divide is filled with
zeros; vectors whose length is not that of the first one are kept, with null code and error; components of any magnitude are exact (beyond 2^26
in Python's integers), an error beyond a long is the largest long; null labels are one label; repeated rows give repeated results; an
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwatch.llm.common import materialise

SMALL = 1 << 26  # up to here squares and sums of a part stay within 64 bits
LONGEST = (1 << 63) - 1
SALTS = 32


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(x: float) -> int:
    """floor(256 x) of any finite number."""
    return math.floor(x * 256) if abs(x) < 2.0**52 else int(x) * 256


def cut(x: list[float], parts: int) -> list[list[int]]:
    """Integer parts of one vector, filled with zeros to a multiple of ``parts``."""
    size = -(-len(x) // parts)
    ints = [scaled(c) for c in x] + [0] * (size * parts - len(x))
    return [ints[k * size : (k + 1) * size] for k in range(parts)]


class Cells:
    """Nearest entries of one part position: index (the lower on ties) and squared distance."""

    def __init__(self, entries: list[list[int]], shift: int, most: int = 16_384):
        self.plain = entries
        self.small = all(abs(c) <= SMALL for e in entries for c in e)
        self.entries = np.array(entries, np.int64) if self.small else None
        self.shift, self.most, self.known = shift, most, {}

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries that none dominates over its box, ascending, as a row; the last one is repeated up to the widest row's size."""
        low = cells << self.shift
        high = low + (1 << self.shift) - 1
        e = self.entries[None]
        gap = np.maximum(np.maximum(low[:, None] - e, e - high[:, None]), 0)
        far = np.maximum(np.abs(e - low[:, None]), np.abs(high[:, None] - e))
        keep = (gap * gap).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]
        width = keep.sum(axis=1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : width.max()]
        return np.take_along_axis(order, np.minimum(np.arange(order.shape[1])[None], width[:, None] - 1), axis=1).astype(np.int16)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        cells, of = np.unique(parts >> self.shift, axis=0, return_inverse=True)
        of = of.reshape(-1)
        names = [c.tobytes() for c in cells]
        if len(self.known) + len(names) > self.most:
            self.known.clear()
        new = [k for k, name in enumerate(names) if name not in self.known]
        for s in range(0, len(new), 512):
            some = new[s : s + 512]
            for k, row in zip(some, self.candidates(cells[some])):
                self.known[names[k]] = row[: int((row != row[-1]).sum()) + 1].copy()
        rows = [self.known[name] for name in names]
        width = np.array([len(r) for r in rows])
        index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for w in np.unique(width):  # cells with equally many candidates together
            here = np.flatnonzero(width == w)
            table = np.zeros(len(names), np.int64)
            table[here] = np.arange(len(here))
            options = np.array([rows[k] for k in here], np.int64)
            mine = np.flatnonzero(width[of] == w)
            for s in range(0, len(mine), 8192):
                at = mine[s : s + 8192]
                among = options[table[of[at]]]
                d = self.entries[among] - parts[at][:, None]
                d = (d * d).sum(axis=2)
                best = d.argmin(axis=1)
                index[at], distance[at] = among[np.arange(len(at)), best], d[np.arange(len(at)), best]
        return index, distance

    def nearest_large(self, part: list[int]) -> tuple[int, int]:
        """The same for components that 64 bits may not square."""
        d, k = min((sum((a - b) ** 2 for a, b in zip(e, part)), k) for k, e in enumerate(self.plain))
        return k, d


def cell_shift(entries: list[list[int]]) -> int:
    """Cells about half as wide as the entries' mean spacing along a component."""
    spread = max((max(c) - min(c) for c in zip(*entries)), default=0)
    per_side = max(1.0, len(entries) ** (1 / max(1, len(entries[0]))))
    return max(0, int(spread / per_side / 2).bit_length() - 1)


class Coder:
    """All part positions of a codebook: books[part][entry][component]."""

    def __init__(self, books: list[list[list[int]]], dim: int):
        self.books, self.dim, self.parts, self.size = books, dim, len(books), len(books[0][0])
        self.cells = [Cells(b, cell_shift(b)) for b in books]

    def split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, list[list[int]]]]:
        """Row numbers and integer parts (rows, parts, size) of vectors with small components; integer parts of the others, by row number."""
        n = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        right = np.flatnonzero(n == self.dim)
        flat = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(right), self.dim)
        fits = (np.abs(flat) <= SMALL / 256).all(axis=1)
        ints = np.zeros((int(fits.sum()), self.parts * self.size), np.int64)
        ints[:, : self.dim] = np.floor(flat[fits] * 256)
        large = {int(k): cut(x.tolist(), self.parts) for k, x in zip(right[~fits], flat[~fits])}
        return right[fits], ints.reshape(len(ints), self.parts, self.size), large

    def assign(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | list, np.ndarray | list]]:
        """For each part position: (part, rows, parts, nearest entries, squared distances); large vectors one at a time."""
        rows, ints, large = self.split(column)
        for p, cells in enumerate(self.cells):
            mine = np.ascontiguousarray(ints[:, p])
            if len(rows) and cells.small:
                yield p, rows, mine, *cells.nearest(mine)
            else:
                for r, part in zip(rows, mine.tolist()):
                    k, d = cells.nearest_large(part)
                    yield p, np.array([r]), [part], [k], [d]
            for r, part in large.items():
                k, d = cells.nearest_large(part[p])
                yield p, np.array([r]), [part[p]], [k], [d]


def moved(vectors: DataFrame, books: list[list[list[int]]], dim: int) -> list[list[list[int]]]:
    """One round: entries become the floored means of their parts; an entry without parts stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, dim)
        total = {}
        for b in batches:
            for p, _, parts, index, _ in coder.assign(b.column("v")):
                if isinstance(index, np.ndarray):
                    order = np.argsort(index, kind="stable")
                    seen, first = np.unique(index[order], return_index=True)
                    added = np.add.reduceat(parts[order], first, axis=0).tolist() if parts.shape[1] else [[]] * len(seen)
                    some = zip(seen.tolist(), np.diff([*first, len(order)]).tolist(), added)
                else:
                    some = [(index[0], 1, parts[0])]
                for k, n, s in some:
                    had = total.get((p, k))
                    total[p, k] = (n, s) if had is None else (had[0] + n, [x + y for x, y in zip(had[1], s)])
        rows = [(p, k, n, list(map(str, s))) for (p, k), (n, s) in total.items()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["part", "entry", "n", "sums"])

    def merge(t: pa.Table) -> pa.Table:
        n = sum(t.column("n").to_pylist())
        means = [str(sum(map(int, x)) // n) for x in zip(*t.column("sums").to_pylist())]
        return pa.table({"part": [t.column("part")[0].as_py()], "entry": [t.column("entry")[0].as_py()], "mean": [means]},
                        pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("mean", pa.list_(pa.string()))]))

    partial = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<string>")
    found = partial.groupBy("part", "entry").applyInArrow(merge, "part int, entry int, mean array<string>").collect()  # parts * entries rows at most
    out = [[list(e) for e in b] for b in books]
    for r in found:
        out[r["part"]][r["entry"]] = [int(x) for x in r["mean"]]
    return out


def books_sha256(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[list[list[int]]], int] | None:
    """(codebooks, length of the vectors), or None without vectors."""
    lead = vectors.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not lead:
        return None
    dim = len(lead[0]["v"])
    first = [cut(r["v"], parts) for r in lead if len(r["v"]) == dim]
    books = [[x[p] for x in first] for p in range(parts)]
    for _ in range(rounds):
        books = moved(vectors, books, dim)
    return books, dim


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every finite vector."""
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    vectors = table.filter(finite(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fitted = fit(vectors, parts, entries, rounds)
    books, dim = fitted or ([[[]]] * parts, 0)
    id_type, label_type = vectors.schema["id"].dataType, vectors.schema["label"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, dim)
        for b in batches:
            codes, errors, right = np.zeros((b.num_rows, parts), np.uint8), [0] * b.num_rows, np.zeros(b.num_rows, bool)
            for p, rows, _, index, distance in coder.assign(b.column("v")):
                codes[rows, p] = index
                right[rows] = True
                for r, d in zip(rows.tolist(), distance if isinstance(distance, list) else distance.tolist()):
                    errors[r] += d
            code = [bytes(c).hex() if ok else None for c, ok in zip(codes, right)]
            error = [min(e, LONGEST) if ok else None for e, ok in zip(errors, right)]
            cols = [b.column("id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds)], ["vec_id", "label", "code", "error"])

    kinds = [to_arrow_type(id_type), to_arrow_type(label_type), pa.string(), pa.int64()]
    schema = f"vec_id {id_type.simpleString()}, label {label_type.simpleString()}, code string, error long"
    coded = materialise(vectors.mapInArrow(encode, schema))
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.when(wide.isNotNull(), F.least(wide, F.lit(LONGEST).cast("decimal(38,0)"))).cast("long").alias("label_error"))
    # a label may hold a third of all rows: rows are dealt to SALTS copies of its total
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumnRenamed("label", "_label")
    joined = salted.join(copies, (salted["_salt"] == copies["_salt"]) & salted["label"].eqNullSafe(copies["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
