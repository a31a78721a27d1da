"""Streaming queries over the events table, run to their end; each must equal its batch counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.plans.ingest import _CASE, _events
from loomwatch.session import shared_dir
from loomwatch.sources import growing
from loomwatch.streaming import live


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, because the stream source takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    place = _place(spark)
    live.run_to_end(stream, f"{place}/out", f"{place}/checkpoint", mode)
    return spark.read.parquet(f"{place}/out")


def stream_dedupe(spark, sf_dir):
    """Events twice over, once left."""
    e = _stream(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    d = _finish(spark, live.dedupe(twice, "ts", ("event_id", "user_id", "event_type")))
    return d.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_bruteforce(spark, sf_dir):
    e = _stream(spark, sf_dir).filter("event_type = 'error'").select(F.col("user_id").alias("source"), F.unix_micros("ts").alias("us"))
    d = _finish(spark, live.peak_failures(e, 3 * 86_400_000_000, idle_us=400 * 86_400_000_000), "update")
    per = d.groupBy("source", "since").agg(F.max("failures").alias("failures"), F.max("peak").alias("peak"))
    return per.groupBy("source").agg(F.sum("failures").alias("failures"), F.max("peak").alias("peak"))


def stream_sessions(spark, sf_dir):
    """All sessions as of the last micro-batch, the open ones too."""
    e = _stream(spark, sf_dir).select("ts", "user_id")
    d = _finish(spark, live.sessions(e, "ts", "user_id", 6 * 3600, "0 seconds"), "complete")
    last = d.agg(F.max("batch").alias("batch"))
    d = d.join(F.broadcast(last), "batch")
    return d.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Events as log lines of a folder; every seventh line is none that a parser takes."""
    e = _events(spark, sf_dir)
    raw = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "want_level", "host", "body")
    line = F.when(F.pmod("n", F.lit(7)) == 0, F.concat(F.lit("?? "), F.col("n").cast("string"))).otherwise(raw)
    place = _place(spark)
    e.select(line.alias("value")).write.text(f"{place}/plain")
    return place


def followed_levels(spark, sf_dir):
    """Lines of files that a stream follows, by level; those that no parser takes are UNKNOWN."""
    place = _written(spark, sf_dir)
    lines = growing.followed_lines(spark, f"{place}/plain")
    d = _finish(spark, live.records_or_unknown(lines, ["canonical", "iso8601", "apache"]))
    return d.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("run_id", "n").alias("places"))


def decoded_files(spark, sf_dir):
    """The same lines by byte ranges in a batch: lines, longest number of each file added up, lines that no parser takes."""
    d = growing.decoded_lines(spark, f"{_written(spark, sf_dir)}/plain", 1 << 16)
    per = d.groupBy("run_id", "encoding").agg(F.count("*").alias("n"), F.max("n").alias("last"), F.count_if(F.col("raw").startswith("??")).alias("odd"))
    return per.groupBy("encoding").agg(F.sum("n").alias("n"), F.sum("last").alias("last"), F.sum("odd").alias("odd"))


def stream_quality(spark, sf_dir):
    """Rows received, unparsed and dropped as too late, from the progress of a query over events."""
    e = _stream(spark, sf_dir).withColumn("bad", F.col("event_type") == "view")
    place = _place(spark)
    q = live.run_to_end(live.dedupe(live.counted(e, "bad"), "ts", ("event_id",)), f"{place}/out", f"{place}/checkpoint")
    d = spark.createDataFrame(live.progress_rows(q), "batch long, received long, unparsed long, dropped long")
    return d.agg(F.sum("received").alias("received"), F.sum("unparsed").alias("unparsed"), F.sum("dropped").alias("dropped"))


QUERIES = {f.__name__: f for f in (stream_dedupe, stream_bruteforce, stream_sessions, followed_levels, decoded_files, stream_quality)}
ORACLES = {
    "followed_levels": f"""
SELECT CASE WHEN event_id % 7 = 0 THEN 'UNKNOWN' ELSE {_CASE} END AS level, count(*) AS n, count(*) AS places FROM events GROUP BY 1""",
    "decoded_files": "SELECT 'utf-8' AS encoding, count(*) AS n, count(*) AS last, count(*) FILTER (WHERE event_id % 7 = 0) AS odd FROM events",
    "stream_quality": "SELECT count(*) AS received, count(*) FILTER (WHERE event_type = 'view') AS unparsed, CAST(0 AS BIGINT) AS dropped FROM events",
    "stream_dedupe": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_bruteforce": """
WITH f AS (SELECT user_id AS source, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS w FROM events WHERE event_type = 'error')
SELECT source, count(*) AS failures, max(w) AS peak FROM f GROUP BY source""",
    "stream_sessions": """
WITH g AS (SELECT user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS x FROM events)
SELECT user_id, CAST(sum(x) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id""",
}
