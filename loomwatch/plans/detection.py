"""Detection rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.operators import auth
from loomwatch.session import table

DAY_US = 86_400_000_000


def auth_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.lit("events").alias("run_id"),
        F.col("user_id").alias("source"),
        F.col("event_id").alias("n"),
        F.unix_micros("ts").alias("us"),
        F.col("event_type").alias("user"),
    )
    out = auth.bruteforce(
        e.filter(F.col("user") == "error"), e.filter(F.col("user") == "purchase"), 3 * DAY_US, 5, DAY_US
    )
    return out.select("source", "failures", "peak", "first_n", "last_n", "success_n", "severity")


QUERIES = {"auth_bruteforce": auth_bruteforce}
ORACLES = {
    "auth_bruteforce": """
WITH e AS (SELECT user_id AS source, event_id AS n, epoch_us(ts) AS us, event_type FROM events),
f AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS w
      FROM e WHERE event_type = 'error'),
g AS (SELECT source, count(*) AS failures, max(w) AS peak, min(n) AS first_n, max(n) AS last_n, max(us) AS last_us
      FROM f GROUP BY source HAVING count(*) >= 5),
s AS (SELECT g.source, min(e.n) AS success_n FROM g JOIN e ON e.source = g.source AND e.event_type = 'purchase'
      AND e.us BETWEEN g.last_us AND g.last_us + 86400000000 GROUP BY g.source)
SELECT g.source, failures, peak, first_n, last_n, success_n,
       CASE WHEN success_n IS NOT NULL THEN 'critical' WHEN peak >= 5 THEN 'high' ELSE 'medium' END AS severity
FROM g LEFT JOIN s USING (source)"""
}
