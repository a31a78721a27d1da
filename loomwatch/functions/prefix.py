"""Running sums over a run in blocks of its line numbers: no window takes a run, but one of block totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 100_000


def running_sum(df: DataFrame, value: Column, out: str, run: str = "run_id", order: str = "n", block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the run's rows up to each row."""
    d = df.withColumn("_prefix_v", value).withColumn("_prefix_blk", F.floor(F.col(order) / block))
    inside = F.sum("_prefix_v").over(W.partitionBy(run, "_prefix_blk").orderBy(order))
    d = d.withColumn("_prefix_in", inside)
    before = F.sum("_prefix_s").over(W.partitionBy(run).orderBy("_prefix_blk").rowsBetween(W.unboundedPreceding, -1))
    totals = d.groupBy(run, "_prefix_blk").agg(F.sum("_prefix_v").alias("_prefix_s"))
    base = totals.select(F.col(run).alias("_prefix_run"), F.col("_prefix_blk").alias("_prefix_of"), F.coalesce(before, F.lit(0)).alias("_prefix_base"))
    joined = d.join(base, F.col(run).eqNullSafe(F.col("_prefix_run")) & (F.col("_prefix_blk") == F.col("_prefix_of")))
    return joined.withColumn(out, F.col("_prefix_base") + F.col("_prefix_in")).drop("_prefix_v", "_prefix_blk", "_prefix_in", "_prefix_run", "_prefix_of", "_prefix_base")


def before_in_run(df: DataFrame, value: str, out: str, run: str = "run_id", order: str = "n", block: int = BLOCK) -> DataFrame:
    """Adds ``out``: ``value`` of the run's row before, null for the first. Blocks hand on the value of their last row."""
    d = df.withColumn("_prefix_blk", F.floor(F.col(order) / block))
    d = d.withColumn("_prefix_lag", F.lag(F.struct(value)).over(W.partitionBy(run, "_prefix_blk").orderBy(order)))
    last = d.groupBy(run, "_prefix_blk").agg(F.max_by(F.struct(value), order).alias("_prefix_last"))
    handed = last.select(F.col(run).alias("_prefix_run"), F.col("_prefix_blk").alias("_prefix_of"), F.lag("_prefix_last").over(W.partitionBy(run).orderBy("_prefix_blk")).alias("_prefix_before"))
    joined = d.join(handed, F.col(run).eqNullSafe(F.col("_prefix_run")) & (F.col("_prefix_blk") == F.col("_prefix_of")))
    return joined.withColumn(out, F.coalesce("_prefix_lag", "_prefix_before")[value]).drop("_prefix_blk", "_prefix_lag", "_prefix_run", "_prefix_of", "_prefix_before")
