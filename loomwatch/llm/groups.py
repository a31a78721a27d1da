"""Self-joins of groups of any size as blocks: no task takes a whole hot group, and no pair leaves its task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def in_blocks(members: DataFrame, key: list[str], size: Column | str, ident: str, block: int) -> DataFrame:
    """Deals each group's members into blocks of about ``block`` rows and sends each row to every pair of blocks
    that its own block belongs to: adds _i <= _j (the pair) and _mine. A group within one block is sent once.

    ``size`` is the group's row count. Rows of a pair meet in one task; a group of m rows costs m * (m / block)
    rows, and its m * m / 2 comparisons are spread over (m / block)^2 / 2 tasks.
    """
    n = F.ceil((F.col(size) if isinstance(size, str) else size) / F.lit(block)).cast("int")
    d = members.withColumn("_n", n).withColumn("_mine", F.when(F.col("_n") <= 1, 0).otherwise(F.pmod(F.xxhash64(ident), F.col("_n"))).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)))))
    return d.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other")).drop("_n", "_other")


def by_group(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by key."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        change = np.zeros(b.num_rows, bool)
        for k in key:
            c = b.column(k)
            if b.num_rows > 1:
                change[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(change).tolist()
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in key):
            yield pa.concat_tables(held)
            held = []
        for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
            if e < b.num_rows:
                yield pa.concat_tables([*held, t.slice(s, e - s)]) if held else t.slice(s, e - s)
                held = []
            else:
                held.append(t.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


def map_groups(
    df: DataFrame, key: list[str], fn: Callable[[pa.Table], tuple[np.ndarray, ...] | None], schema: str, flush: int = 20_000
) -> DataFrame:
    """Applies ``fn`` to the rows of each key, streaming through sorted partitions. ``fn`` returns one array for
    each column of ``schema``, or None; small results go out together."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(c), kinds[k]) for c, (_, k) in zip(zip(*held), fields)]
            return pa.RecordBatch.from_arrays(cols, [n for n, _ in fields])

        for t in by_group(batches, key):
            got = fn(t)
            if got is not None and len(got[0]):
                held.append(got)
                rows += len(got[0])
                if rows >= flush:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)
