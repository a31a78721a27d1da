"""Sinks: event store, findings export, upserts, reports, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def event_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in ``order`` stays, whole. Combined before the shuffle; no key is gathered."""
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
    return kept.select("_first.*")


def new_rows(rows: DataFrame, held: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key the store does not hold, the first of each key."""
    return first_of(rows, [key], order).join(held.select(key), key, "left_anti")


def append_new(events: DataFrame, path: str, ts: str = "ts", keys: tuple[str, ...] = ("ts", "source", "raw"), order: list[str] | None = None) -> DataFrame:
    """Appends events that the store does not hold, partitioned by day; returns them. Hash equality decides, of equal events the
    first in ``order`` (time, then the other keys) stays; a store that does not exist yet holds nothing."""
    spark = events.sparkSession
    d = events.withColumn("event_hash", event_hash(*keys))
    if exists(spark, path):
        d = new_rows(d, spark.read.parquet(path), "event_hash", order or [ts, *keys])
    else:
        d = first_of(d, ["event_hash"], order or [ts, *keys])
    d = d.withColumn("day", F.to_date(ts))
    d.write.mode("append").partitionBy("day").parquet(path)
    return d


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def export_findings(findings: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV, JSON or XML; arrays become text joined by '; '."""
    flat = findings.select(*(F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in findings.dtypes))
    if fmt == "xml":
        flat.write.format("xml").option("rowTag", "finding").option("rootTag", "findings").save(path)
    elif fmt == "csv":
        flat.write.option("header", True).csv(path)
    else:
        flat.write.json(path)


def report(findings: DataFrame, inputs: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: findings by source and the digest of its input. In: findings (run_id, source), inputs (run_id, content)."""
    per = findings.groupBy(key).agg(F.count("*").alias("findings"), F.count_if(F.col("source") == "model").alias("model"), F.count_if(F.col("source") != "model").alias("rules"))
    return inputs.select(key, F.sha2("content", 256).alias("input_sha256")).join(per, key, "left").na.fill(0)


def retain(table: DataFrame, ts: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows on or after the cutoff, and a count of the others; rows without a time stay."""
    keep = F.coalesce(F.col(ts) >= cutoff, F.lit(True))
    return table.filter(keep), table.filter(~keep).agg(F.count("*").alias("removed"))
