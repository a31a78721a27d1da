"""Line scans: physical line numbers on splittable text, encodings, format detection, acceptance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.sources import growing


def numbered_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(run_id, n, raw): run_id is the file, n its physical 1-based line number, blank lines included.

    A file read in several splits is numbered by prefix sums over its splits, so no file meets in one task:
    lines get a number within their split, and only one count per split is summed up."""
    reader = spark.read.option("encoding", encoding) if encoding else spark.read
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), F.regexp_replace("value", r"\r$", "").alias("raw"),
    )
    first = lines.groupBy("run_id", "block").agg(F.min("mid").alias("first"), F.count("*").alias("rows"))
    w = W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = first.withColumn("before", F.coalesce(F.sum("rows").over(w), F.lit(0))).drop("rows")
    return lines.join(offsets, ["run_id", "block"]).select(
        "run_id", (F.col("mid") - F.col("first") + F.col("before") + 1).alias("n"), "raw"
    )


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, encoding) of each file that is not empty, from its first bytes, which alone are read: mark, NUL density, UTF-8, Windows-1252, Latin-1."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"run_id": pdf["path"], "encoding": [growing.encoding_of(growing.head(p)) for p in pdf["path"]]})

    names = spark.read.format("binaryFile").load(path).select("path")  # the content column is not read
    return names.mapInPandas(run, "run_id string, encoding string")


#: (format, what a line looks like, least share of the first lines), in order of priority.
SNIFFERS: list[tuple[str, str, float]] = [
    ("auth_csv", r"(?i)^[^,]*time[^,]*,.*(ip_address|src_ip|source_ip|client_ip).*status.*$", 0.0),
    ("forwarded", P.FORWARDED, 0.5),
    ("logcat", P.LOGCAT, 2 / 3),
    ("rfc5424", P.RFC5424, 0.5),
    ("iso8601", P.ISO_SYSLOG.replace(r")\s+(\S+)\s+(.*)$", rf")\s+(?!(?:{P.LEVEL_WORDS})\s)(\S+)\s+(.*)$"), 0.5),
    ("jsonlog", r"^\s*\{.*\}\s*$", 0.6),
    ("apache", P.APACHE, 0.6),
    ("zookeeper", P.ZOOKEEPER, 0.6),
    ("hadoop", P.HADOOP, 0.6),
    ("spark", P.SPARK, 0.6),
    ("hdfs", P.HDFS, 0.6),
    ("openstack", P.OPENSTACK, 0.6),
    ("bgl", P.BGL, 0.6),
    ("thunderbird", P.THUNDERBIRD, 0.6),
    ("proxifier", P.PROXIFIER, 0.6),
    ("windows_cbs", P.WINDOWS_CBS, 0.6),
    ("canonical", P.CANONICAL, 0.0),
    ("rfc3164", P.RFC3164, 0.0),
]


def sniff(lines: DataFrame, probe: int = 50) -> DataFrame:
    """(run_id, format) from the first ``probe`` non-blank lines of each run; ``unknown`` or ``empty`` else."""
    w = W.partitionBy("run_id").orderBy("n")
    head = lines.filter(F.trim("raw") != "").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= probe)
    counts = head.groupBy("run_id").agg(
        F.count("*").alias("_n"), *(F.count_if(F.col("raw").rlike(rx)).alias(f"_{name}") for name, rx, _ in SNIFFERS)
    )
    choice: Column | None = None
    for name, _, share in SNIFFERS:
        hit = (F.col(f"_{name}") > 0) & (F.col(f"_{name}") >= F.col("_n") * share)
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    runs = lines.select("run_id").distinct()
    return runs.join(counts, "run_id", "left").select(
        "run_id", F.when(F.col("_n").isNull(), "empty").otherwise(choice.otherwise("unknown")).alias("format")
    )


def universal_format(files: DataFrame, head: str = "head") -> DataFrame:
    """(run_id, format) by suffix, then by what the first kilobytes look like. In: (run_id, head)."""
    path, t = F.lower("run_id"), F.trim(head)
    lines = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^\s*\{.*\}\s*$"), F.lit(0)))
    by_text = (
        F.when(t.rlike(r"(?is)^(<\?xml[^>]*>\s*)?<(events?|event)\b"), "evtx_xml").when(t.rlike(r"(?is)^<(!doctype\s+html|html)\b"), "html").when(t.startswith("<"), "xml")
        .when(lines >= 2, "jsonl").when(t.rlike(r"^[\[{]"), "json").when(t.rlike(r"(?im)^\s*EventCode\s*="), "windows_text").when(t.rlike("(?m)" + P.WINDOWS_CBS.replace("(?i)", "(?i)")), "windows_cbs")
        .when(t.rlike(r"^[^\n,;\t|]+([,;\t|][^\n,;\t|]+){2,}\n"), "csv").otherwise("text")
    )
    by_suffix = F.when(path.endswith(".evtx"), "evtx").when(path.rlike(r"\.html?$"), "html").when(path.rlike(r"\.(jsonl|ndjson)$"), "jsonl").when(path.endswith(".csv"), "csv").when(path.endswith(".tsv"), "csv")
    return files.select("run_id", F.when(t == "", "empty").otherwise(F.coalesce(by_suffix, by_text)).alias("format"))


def accept_native(native: DataFrame, universal: DataFrame, coverage: DataFrame, least: float = 0.6) -> DataFrame:
    """Native records of runs whose parsed share reaches ``least``, the universal parser's for the others."""
    good = coverage.filter((F.col("total") > 0) & (F.col("parsed") >= F.col("total") * least)).select("run_id")
    return native.join(good, "run_id", "left_semi").unionByName(universal.join(good, "run_id", "left_anti"), allowMissingColumns=True)


def coverage(lines: DataFrame, records: DataFrame, examples: int = 5) -> DataFrame:
    """Per run: total, parsed, unparsed, examples of unparsed lines in file order, and a verdict."""
    got = records.select("run_id", "n", F.lit(True).alias("ok"))
    seen = lines.filter(F.trim("raw") != "").join(got, ["run_id", "n"], "left")
    w = W.partitionBy("run_id").orderBy("n")
    bad = seen.filter(F.col("ok").isNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= examples)
    shown = bad.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("n", "raw"))).alias("_x"))
    per = seen.groupBy("run_id").agg(F.count("*").alias("total"), F.count("ok").alias("parsed"))
    runs = lines.select("run_id").distinct()
    zero = F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("parsed", F.lit(0)).alias("parsed")
    out = runs.join(per, "run_id", "left").join(shown, "run_id", "left").select("run_id", *zero, F.col("_x.raw").alias("examples"))
    return out.withColumn("unparsed", F.col("total") - F.col("parsed")).withColumn(
        "verdict", F.when(F.col("total") == 0, "empty").when(F.col("parsed") == 0, "unrecognised").otherwise("parsed")
    )
