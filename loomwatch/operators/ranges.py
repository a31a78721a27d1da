"""Points in ranges as an equi-join on bins, whatever the ranges' lengths and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bits of a number within a block: a window of running totals takes 2^BITS distinct numbers at most.
BITS = 17


def _level(lo: Column, hi: Column) -> Column:
    """The least k for which 2^k bins hold the range, so that it touches two of them at most."""
    return F.length(F.bin((hi - lo).cast("long"))) * (hi > lo).cast("int")


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Every point with every range of its group (``on``, nulls equal nothing) for which lo <= at <= hi. In: whole-number columns; other columns
    of both sides are kept and must differ.

    A range lies in the bins of its two ends at the level that its length sets; a point has one bin a level, for the levels that occur (64 at most,
    the only thing that reaches the driver). At least a quarter of an evenly filled bin is inside the range, so the candidates follow the result; neither a
    long run nor a long range meets in one task. Ranges without an end, or upside down, hold nothing."""
    r = ranges.filter(F.col(lo) <= F.col(hi)).withColumn("_level", _level(F.col(lo), F.col(hi)))
    levels = sorted(x["_level"] for x in r.select("_level").distinct().collect())
    ends = F.array_distinct(F.array(*(F.expr(f"shiftright(cast({c} as long), _level)") for c in (lo, hi))))
    r = r.withColumn("_bin", F.explode(ends)).select(*ranges.columns, "_level", "_bin")
    each = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col(at).cast("long"), k).alias("bin")) for k in levels or [0]))
    p = points.withColumn("_b", F.explode(each)).select(*points.columns, F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin"))
    return p.join(r, [*on, "_level", "_bin"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_level", "_bin")


def _around(d: DataFrame, on: list[str], levels: int, bits: int) -> DataFrame:
    """(on, _v, _c, _min, _max, _before, _last, _next): of each number of a group, the sum of ``_c`` and the greatest ``_max`` of the lesser ones, and the least
    ``_min`` of the greater ones. In: (on, _v, _c, _min, _max), each number once. Blocks of 2^bits numbers hand on their totals, which are numbers of the next level."""
    keys = [*on, "_blk"] if levels > 1 else on
    d = d.withColumn("_blk", F.shiftright("_v", bits))
    up = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*keys).orderBy(F.desc("_v")).rowsBetween(W.unboundedPreceding, -1)
    d = d.select("*", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_before"), F.max("_max").over(up).alias("_last"), F.min("_min").over(down).alias("_next"))
    if levels > 1:
        blocks = d.groupBy(*keys).agg(F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max")).withColumnRenamed("_blk", "_v")
        base = _around(blocks, on, levels - 1, bits).select(*on, F.col("_v").alias("_blk"), F.col("_before").alias("_b"), F.col("_last").alias("_l"), F.col("_next").alias("_n"))
        d = d.join(base, keys).withColumns({"_before": F.col("_before") + F.col("_b"), "_last": F.coalesce("_last", "_l"), "_next": F.coalesce("_next", "_n")}).drop("_b", "_l", "_n")
    return d.drop("_blk")


def range_totals(points: DataFrame, ranges: DataFrame, on: list[str], at: str, lo: str, hi: str, bits: int = BITS) -> DataFrame:
    """Each range that holds a point of its group (``on``, nulls equal nothing), with ``records`` (points in it), ``first`` and ``last`` (the least and the greatest).

    What ``range_join`` gives when counted, but no point meets a range: both ends of a range look up running totals over the distinct numbers, so the work follows
    points and ranges, however much they overlap. In: whole-number columns."""
    p, r = points.dropna(subset=[*on, at]), ranges.filter(F.col(lo) <= F.col(hi))
    p = p.groupBy(*on, F.col(at).cast("long").alias("_v")).agg(F.count("*").alias("_c"))
    ends = r.select(*on, F.explode(F.array(F.col(lo).cast("long"), F.col(hi).cast("long"))).alias("_v"), F.lit(0).cast("long").alias("_c"))
    line = p.unionByName(ends).groupBy(*on, "_v").agg(F.sum("_c").alias("_c"))
    own = F.when(F.col("_c") > 0, F.col("_v"))
    a = line.agg(F.min("_v").alias("a"), F.max("_v").alias("b")).collect()[0]
    levels = max(1, -(-((a["b"] >> bits) - (a["a"] >> bits) + 1).bit_length() // bits) + 1) if a["a"] is not None else 1
    line = _around(line.withColumn("_min", own).withColumn("_max", own), on, levels, bits)
    low = line.select(*on, F.col("_v").alias(lo), F.col("_before"), F.coalesce("_min", "_next").alias("first"))
    high = line.select(*on, F.col("_v").alias(hi), (F.col("_before") + F.col("_c")).alias("_upto"), F.coalesce("_max", "_last").alias("last"))
    d = r.join(low, [*on, lo]).join(high, [*on, hi]).withColumn("records", F.col("_upto") - F.col("_before")).filter("records > 0")
    kind = points.schema[at].dataType
    return d.select(*ranges.columns, "records", F.col("first").cast(kind).alias("first"), F.col("last").cast(kind).alias("last"))
