"""Brute-force detection: peak failures in a trailing window, then a success shortly after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def peak_in_window(events: DataFrame, keys: list[str], us: str, window_us: int) -> DataFrame:
    """Adds ``in_window``: rows of the same keys in the trailing window, both ends included."""
    w = W.partitionBy(*keys).orderBy(us).rangeBetween(-window_us, W.currentRow)
    return events.withColumn("in_window", F.when(F.col(us).isNotNull(), F.count(us).over(w)))


def bruteforce(
    failures: DataFrame,
    successes: DataFrame,
    window_us: int = 120_000_000,
    min_failures: int = 5,
    success_us: int = 120_000_000,
) -> DataFrame:
    """Sources with enough failures.

    In: (run_id, source, n, us, user) for failures, (run_id, source, n, us) for successes. Rows without
    a time count as failures but not for the peak. Severity is critical when a success follows the last
    failure within ``success_us``, high when the peak reaches the minimum or no row has a time, else medium.
    """
    narrow = failures.select("run_id", "source", "n", "us", "user")
    per = (
        peak_in_window(narrow, ["run_id", "source"], "us", window_us)
        .groupBy("run_id", "source")
        .agg(
            F.count("*").alias("failures"),
            F.min_by("user", "n").alias("first_user"),
            F.min("n").alias("first_n"),
            F.max("n").alias("last_n"),
            F.max("us").alias("last_us"),
            F.max("in_window").alias("peak"),
        )
        .filter(F.col("failures") >= min_failures)
    )
    ok = successes.select("run_id", "source", F.col("n").alias("ok_n"), F.col("us").alias("ok_us"))
    hit = (
        per.select("run_id", "source", "last_us")
        .join(ok, ["run_id", "source"])
        .filter(F.col("ok_us").between(F.col("last_us"), F.col("last_us") + success_us))
        .groupBy("run_id", "source")
        .agg(F.min("ok_n").alias("success_n"))
    )
    return (
        per.join(hit, ["run_id", "source"], "left")
        .withColumn("peak", F.coalesce("peak", F.lit(0)))
        .withColumn(
            "severity",
            F.when(F.col("success_n").isNotNull(), "critical")
            .when(F.col("last_us").isNull() | (F.col("peak") >= min_failures), "high")
            .otherwise("medium"),
        )
    )
