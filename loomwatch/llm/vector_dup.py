"""Near-duplicate vectors by cosine: a subspace pigeonhole join.

Unit vectors with cosine >= c lie within the squared distance e = 2 - 2c. A random rotation spreads the variance
evenly; the rotated vectors are split into blocks of few dimensions with budgets e_b in proportion to their
size that add up to e. If every block's squared distance exceeded its budget, so would the whole: each link is found
in some block. Per block, vectors are range-joined on a grid over the block's first coordinates with cells as
wide as the root of the budget, so that partners lie in the same or a neighbouring cell; of two neighbours the one
whose cell offset comes first probes. Candidates of all blocks are verified by the exact cosine in double precision, each
pair in its first block only, so that the union needs no list of pairs.

Vectors with the same label and components are one class with a count. Cells are joined in blocks of rows, so that a
hot cell is spread over tasks; counts of links and spanning stars leave the tasks, never pairs.

Defined results: only vectors of equal, non-null label are compared; vectors that are null, empty, zero or
hold null or non-finite components link with nothing; vectors of different length never link; repeated vectors are
linked with each other; rows are told apart by a number of their own, so repeated or null vec_ids are vectors like any others (the smallest
vec_id that is not null names a component); very large and very small components are scaled before they are squared; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.common import materialise
from loomwatch.llm.graph import connected_components, spanning_edges
from loomwatch.llm.groups import map_groups

SLACK = 1e-9


def layout(dim: int, block_dims: int) -> list[slice]:
    return [slice(s, min(dim, s + block_dims)) for s in range(0, dim, block_dims)]


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_budgets(dim: int, block_dims: int, cosine: float) -> np.ndarray:
    sizes = np.array([s.stop - s.start for s in layout(dim, block_dims)], float)
    return (2 - 2 * cosine) * sizes / dim + SLACK


def _probes(grid: int) -> list[tuple[int, ...]]:
    """Half of the neighbouring cells: those whose first non-zero step is positive, and the cell itself first."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=grid) if next((x for x in s if x), 0) > 0]
    return [(0,) * grid, *steps]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component is brought to one first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells(classes: DataFrame, cosine: float, block_dims: int, grid: int, seed: int) -> DataFrame:
    """rep, copies, vec, label, dim, blk, cell (hash), home: each class once at home and once per probed cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column("vec").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = b.take(pa.array(rows))
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
                y = unit(x) @ rotation(dim, seed)
                budgets = block_budgets(dim, block_dims, cosine)
                for k, s in enumerate(layout(dim, block_dims)):
                    g = min(grid, s.stop - s.start)
                    at = np.floor(y[:, s.start : s.start + g] / np.sqrt(budgets[k])).astype(np.int64)
                    for home, step in [(True, (0,) * g), *((False, p) for p in _probes(g)[1:])]:
                        c = at + np.array(step)
                        code = np.zeros(len(c), np.int64)
                        for d in range(g):
                            code = code * (1 << 20) + (c[:, d] + (1 << 19))
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("rep"), part.column("copies"), part.column("vec"), part.column("label"),
                                pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(code),
                                pa.array(np.full(n, home)),
                            ],
                            ["rep", "copies", "vec", "label", "dim", "blk", "cell", "home"],
                        )

    label, kind = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    return classes.mapInArrow(
        run, f"rep long, copies long, vec {kind}, label {label}, dim int, blk int, cell long, home boolean"
    )


def _compare(cosine: float, block_dims: int, seed: int, chunk: int = 512):
    def fn(t: pa.Table):
        home = t["home"].to_numpy(zero_copy_only=False)
        mine = t["_mine"].to_numpy()
        i, j = t["_i"][0].as_py(), t["_j"][0].as_py()
        if t.num_rows < 2 or not home.any():
            return None
        dim, k = t["dim"][0].as_py(), t["blk"][0].as_py()
        x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
        x = x / np.abs(x).max(axis=1)[:, None]
        norm = np.sqrt((x * x).sum(axis=1))
        y = x / norm[:, None] @ rotation(dim, seed)
        budgets, parts = block_budgets(dim, block_dims, cosine), layout(dim, block_dims)
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        links = np.zeros(len(rep), np.int64)
        left, right = [], []
        h = np.flatnonzero(home)
        for s in range(0, len(rep), chunk):
            a = np.arange(s, min(len(rep), s + chunk))
            for u in range(0, len(h), chunk):
                b = h[u : u + chunk]
                ok = np.where(home[a][:, None], a[:, None] < b[None, :], True)  # home pairs once, probes against home
                if i != j:
                    ok &= mine[a][:, None] != mine[b][None, :]
                near = ok & (_distance(y[a], y[b], parts[k]) <= budgets[k])
                for q in range(k):  # met earlier, in another block
                    if near.any():
                        near &= _distance(y[a], y[b], parts[q]) > budgets[q]
                p, q = np.nonzero(near)
                if not len(p):
                    continue
                p, q = a[p], b[q]
                cos = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q])
                hit = cos >= cosine
                left.append(p[hit])
                right.append(q[hit])
        if not left:
            return None
        p, q = np.concatenate(left), np.concatenate(right)
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        ids, inverse = np.unique(rep, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, inverse, links)
        s, r = spanning_edges(len(ids), inverse[p], inverse[q])
        root = ids.copy()
        root[s] = ids[r]
        some = np.flatnonzero(total)
        return ids[some], total[some], root[some]

    return fn


def _distance(a: np.ndarray, b: np.ndarray, part: slice) -> np.ndarray:
    a, b = a[:, part], b[:, part]
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def vector_duplicates(
    vectors: DataFrame, cosine: float = 0.93, block_dims: int = 16, grid: int = 2, seed: int = 11, block: int = 2048,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    # 32-bit components travel as they are and are widened where they are compared
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"), F.col(label_col).alias("label"))
    v = v.withColumn("row", F.monotonically_increasing_id())
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    # minus zero equals zero
    v = v.withColumn("ok", usable).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind[6:-1])))
    v = materialise(v.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.sha1(F.to_json(F.struct("vec")))))
    same = ["label", "h1", "h2"]
    classes = v.filter("ok").groupBy(*same).agg(
        F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec")
    )
    classes = materialise(classes)
    c = cells(classes.select("rep", "copies", "vec", "label"), cosine, block_dims, grid, seed)
    key = ["label", "dim", "blk", "cell"]
    sized = c.filter("home").groupBy(*key).agg(F.count("*").alias("m"))
    d = c.join(sized, key)
    n = F.ceil(F.col("m") / F.lit(block)).cast("int")
    d = d.withColumn("_n", n).withColumn("_mine", F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("_n"))).otherwise(-1).cast("int"))
    # a home row meets the other blocks of its cell; a probe meets every block once
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = d.withColumn("_i", F.when(F.col("home"), F.least("_mine", "_other")).otherwise(F.col("_other")))
    d = d.withColumn("_j", F.when(F.col("home"), F.greatest("_mine", "_other")).otherwise(F.col("_other"))).drop("_n", "_other", "m")
    found = materialise(
        map_groups(d, [*key, "_i", "_j"], _compare(cosine, block_dims, seed), "rep long, links long, root long")
    )
    comp = connected_components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    member = comp.select(F.col("id").alias("rep"), "component")
    named = classes.join(member, "rep").groupBy("component").agg(F.min("least").alias("name"))
    by_class = (
        classes.select(*same, "rep", "least", "copies")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(member.join(named, "component").select("rep", "name"), "rep", "left")
        .select(*same, F.coalesce("name", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    alone = v.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        v.filter("ok").join(by_class, same).select("vec_id", "n_links", "component_id").unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
