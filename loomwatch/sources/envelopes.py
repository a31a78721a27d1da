"""Per-format ingest: numbered lines in, records out. Lines that do not match are left out and show up as unparsed in
``lines.coverage``; nothing is guessed for them.

Every parser is a list of column expressions over ``raw``; formats without a year take the file's base year and roll over when the
month jumps back by more than six."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.functions.prefix import before_in_run, running_sum

RECORD = ["run_id", "n", "ts", "level", "host", "msg", "raw", "proc", "pid", "format"]


def part(pattern: str, group: int, source: Column | str = "raw") -> Column:
    """A group of the first match; null when there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(source, pattern, group), F.lit(""))


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), default) if default is not None else F.try_element_at(m, key)


def iso_time(text: Column) -> Column:
    """An instant from ISO-8601 text; a time without a zone is UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def level_from_text(msg: Column) -> Column:
    """First hint that matches; INFO if none does."""
    out: Column | None = None
    for rx, level in P.LEVEL_HINTS:
        out = F.when(msg.rlike(rx), level) if out is None else out.when(msg.rlike(rx), level)
    return out.otherwise(P.DEFAULT_LEVEL)


def month_number(name: Column) -> Column:
    return lookup({m: k + 1 for k, m in enumerate(P.MONTHS)}, name)


def with_year(df: DataFrame, base_year: Column, month: str) -> DataFrame:
    """Adds _year: the base year and one more whenever the months of a run's lines fall back by more than six."""
    d = before_in_run(df, month, "_prev")
    jump = F.coalesce(F.col(month) < F.col("_prev") - 6, F.lit(False)).cast("int")
    d = running_sum(d, jump, "_jumps")
    return d.withColumn("_year", (base_year + F.col("_jumps")).cast("int")).drop("_prev", "_jumps")


def stamp(year: Column, month: Column, day: Column, hms: Column, fraction: Column | None = None) -> Column:
    """A UTC instant; impossible dates are null."""
    h, m, s = (F.substring(hms, k, 2).cast("int") for k in (1, 4, 7))
    seconds = s.cast("decimal(8,6)") if fraction is None else (s + fraction).cast("decimal(8,6)")
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), h, m, seconds, F.lit("UTC"))


def finish(df: DataFrame, fmt: str, ts: Column, level: Column, host: Column, msg: Column, proc: Column | None = None, pid: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "run_id", "n", ts.alias("ts"), level.alias("level"), host.alias("host"), msg.alias("msg"), "raw",
        (none if proc is None else proc).alias("proc"), (none if pid is None else pid).alias("pid"), F.lit(fmt).alias("format"),
    )


def process_parts(rest: Column) -> tuple[Column, Column, Column]:
    """proc, pid, msg of ``proc[pid]: msg``; without that shape all of it is the message."""
    is_proc = rest.rlike(P.PROCESS)
    return part(P.PROCESS, 1, rest), part(P.PROCESS, 2, rest), F.when(is_proc, F.regexp_extract(rest, P.PROCESS, 3)).otherwise(rest)


def canonical(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.CANONICAL))
    g = [F.regexp_extract("raw", P.CANONICAL, k) for k in range(1, 5)]
    return finish(d, "canonical", iso_time(g[0]), g[1], g[2], g[3])


def rfc3164(lines: DataFrame, base_year: Column | int = 1970) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.RFC3164)).withColumn("_m", month_number(F.regexp_extract("raw", P.RFC3164, 1)))
    d = with_year(d.filter("_m is not null"), F.lit(base_year) if isinstance(base_year, int) else base_year, "_m")
    g = {k: F.regexp_extract("raw", P.RFC3164, k) for k in range(2, 6)}
    proc, pid, msg = process_parts(g[5])
    return finish(d, "rfc3164", stamp(F.col("_year"), F.col("_m"), g[2], g[3]), level_from_text(msg), g[4], msg, proc, pid)


def iso8601(lines: DataFrame) -> DataFrame:
    g = [F.regexp_extract("raw", P.ISO_SYSLOG, k) for k in range(1, 4)]
    levels = P.LEVEL_WORDS.split("|")
    d = lines.filter(F.col("raw").rlike(P.ISO_SYSLOG) & ~F.upper(g[1]).isin(levels))
    proc, pid, msg = process_parts(g[2])
    return finish(d, "iso8601", iso_time(g[0]), level_from_text(msg), g[1], msg, proc, pid)


def rfc5424(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.RFC5424))
    g = {k: F.regexp_extract("raw", P.RFC5424, k) for k in range(1, 9)}
    dash = lambda c: F.nullif(c, F.lit("-"))
    body = F.trim(F.regexp_replace(F.regexp_replace(g[8], r"^-\s*", ""), r"^(?:\[[^\]]+\]\s*)+", ""))
    app, pid = dash(g[5]), dash(g[6])
    head = F.when(app.isNotNull(), F.concat(app, F.when(pid.isNotNull(), F.concat(F.lit("["), pid, F.lit("]"))).otherwise(""), F.lit(": "))).otherwise("")
    level = lookup(dict(enumerate(P.PRI_LEVELS)), F.pmod(g[1].cast("int"), F.lit(8)))
    return finish(d, "rfc5424", iso_time(dash(g[3])), level, dash(g[4]), F.concat(head, body), app, pid)


def _time_value(text: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text."""
    n = F.try_to_number(F.when(text.rlike(r"^\d{10}(\d{3})?$"), text), F.lit("9999999999999"))
    return F.when(n.isNotNull(), F.timestamp_millis(F.when(n < 100_000_000_000, n * 1000).otherwise(n).cast("long"))).otherwise(iso_time(text))


def jsonlog(lines: DataFrame) -> DataFrame:
    """One JSON object a line; keys in any case, aliases in order of preference."""
    d = lines.withColumn("_j", F.from_json("raw", "map<string,string>")).filter(F.col("_j").isNotNull() & F.col("raw").rlike(r"^\s*\{"))
    d = d.withColumn("_f", F.map_from_entries(F.array_distinct(F.transform(F.map_entries("_j"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))
    pick = lambda names: F.coalesce(*(F.try_element_at("_f", F.lit(n)) for n in names))
    msg = F.coalesce(pick(P.JSON_MSG), F.col("raw"))
    given = F.lower(F.trim(pick(P.JSON_LEVEL)))
    return finish(d, "jsonlog", _time_value(pick(P.JSON_TS)), F.coalesce(lookup(P.JSON_LEVELS, given), level_from_text(msg)), pick(P.JSON_HOST), msg)


def logcat(lines: DataFrame, base_year: Column | int = 1970) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.LOGCAT)).withColumn("_m", F.regexp_extract("raw", P.LOGCAT, 1).cast("int"))
    d = with_year(d, F.lit(base_year) if isinstance(base_year, int) else base_year, "_m")
    g = {k: F.regexp_extract("raw", P.LOGCAT, k) for k in range(2, 10)}
    ts = stamp(F.col("_year"), F.col("_m"), g[2], g[3], g[4].cast("int") / 1000)
    return finish(d, "logcat", ts, lookup(P.LOGCAT_LEVELS, g[7]), F.lit(None).cast("string"), g[9], F.trim(g[8]), g[5])


def apache(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.APACHE))
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", P.APACHE, 1), r"^\S+\s+", ""), r"\s+", " ")
    level = lookup(P.JSON_LEVELS, F.lower(F.regexp_extract("raw", P.APACHE, 2)))
    return finish(d, "apache", F.try_to_timestamp(text, F.lit("MMM d HH:mm:ss yyyy")), level, F.lit(None).cast("string"), F.regexp_extract("raw", P.APACHE, 3))


def log4j(lines: DataFrame) -> DataFrame:
    """Five related layouts; the first that matches wins."""
    raw, x = F.col("raw"), F.regexp_extract
    ymd, hms = x("raw", P.HDFS, 1), x("raw", P.HDFS, 2)
    two = F.substring(ymd, 1, 2).cast("int")
    hdfs = F.try_make_timestamp(
        F.when(two < 70, two + 2000).otherwise(two + 1900), *(F.substring(ymd, k, 2).cast("int") for k in (3, 5)),
        *(F.substring(hms, k, 2).cast("int") for k in (1, 3)), F.substring(hms, 5, 2).cast("decimal(8,6)"), F.lit("UTC"),
    )
    milli = lambda rx, a, b: F.try_to_timestamp(F.concat(x("raw", rx, a), F.lit("."), x("raw", rx, b)))
    kinds = [
        (P.ZOOKEEPER, milli(P.ZOOKEEPER, 1, 2), 3, 4),
        (P.HADOOP, milli(P.HADOOP, 1, 2), 3, 4),
        (P.SPARK, F.try_to_timestamp(x("raw", P.SPARK, 1), F.lit("yy/MM/dd HH:mm:ss")), 2, 3),
        (P.HDFS, hdfs, 4, 5),
        (P.OPENSTACK, milli(P.OPENSTACK, 2, 3), 5, 6),
    ]
    ts = level = msg = None
    for rx, when, lv, body in kinds:
        hit = raw.rlike(rx)
        ts = F.when(hit, when) if ts is None else ts.when(hit, when)
        level = F.when(hit, x("raw", rx, lv)) if level is None else level.when(hit, x("raw", rx, lv))
        msg = F.when(hit, x("raw", rx, body)) if msg is None else msg.when(hit, x("raw", rx, body))
    d = lines.withColumn("_level", F.upper(level)).filter("_level is not null")
    named = lookup({"WARNING": "WARN", "FATAL": "CRIT", "CRITICAL": "CRIT", "SEVERE": "ERROR", "TRACE": "DEBUG"}, F.col("_level"), F.col("_level"))
    return finish(d, "log4j", ts, named, F.lit(None).cast("string"), msg)


def bgl(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.BGL))
    ts = F.try_to_timestamp(F.regexp_replace(F.regexp_extract("raw", P.BGL, 5), r"^(\d+-\d+-\d+)-(\d+)\.(\d+)\.(\d+)\.(\d+)$", "$1 $2:$3:$4.$5"))
    named = F.upper(F.regexp_extract("raw", P.BGL, 9))
    level = lookup({"FATAL": "CRIT", "SEVERE": "ERROR", "WARNING": "WARN"}, named, named)
    return finish(d, "bgl", ts, level, F.regexp_extract("raw", P.BGL, 4), F.regexp_extract("raw", P.BGL, 10))


def thunderbird(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.THUNDERBIRD))
    g = {k: F.regexp_extract("raw", P.THUNDERBIRD, k) for k in range(1, 10)}
    ts = stamp(F.substring(g[3], 1, 4), month_number(g[5]), g[6], g[7])
    return finish(d, "thunderbird", ts, level_from_text(g[9]), g[8], g[9])


def proxifier(lines: DataFrame, base_year: int = 1970) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.PROXIFIER))
    g = {k: F.regexp_extract("raw", P.PROXIFIER, k) for k in range(1, 6)}
    level = F.when(g[5].rlike(P.PROXIFIER_ERROR), "ERROR").otherwise("INFO")
    return finish(d, "proxifier", stamp(F.lit(base_year), g[1], g[2], g[3]), level, F.lit(None).cast("string"), g[5], g[4])


def windows_cbs(lines: DataFrame) -> DataFrame:
    d = lines.filter(F.col("raw").rlike(P.WINDOWS_CBS))
    named = F.upper(F.regexp_extract("raw", P.WINDOWS_CBS, 2))
    level = lookup({"VERBOSE": "DEBUG", "INFORMATION": "INFO", "WARNING": "WARN", "CRITICAL": "CRIT"}, named, named)
    channel = F.upper(F.regexp_extract("raw", P.WINDOWS_CBS, 3))
    return finish(d, "windows_cbs", F.try_to_timestamp(F.regexp_extract("raw", P.WINDOWS_CBS, 1)), level, F.lit(None).cast("string"), F.regexp_extract("raw", P.WINDOWS_CBS, 4), channel)


def generic(lines: DataFrame) -> DataFrame:
    """Any non-blank line: the first time found by the ordered patterns, the level from its words."""
    d = lines.filter(F.trim("raw") != "")
    found = F.coalesce(*(F.nullif(F.regexp_extract("raw", rx, 0), F.lit("")) for rx in P.TIME_ANYWHERE))
    ts = F.coalesce(_time_value(found), F.try_to_timestamp(found, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), F.try_to_timestamp(found, F.lit("M/d/yyyy h:mm:ss a")))
    return finish(d, "generic", ts, level_from_text(F.col("raw")), F.lit(None).cast("string"), F.col("raw"))


def forwarded(lines: DataFrame, base_year: Column | int = 1970) -> DataFrame:
    """Forwarded syslog with a ``|PRI|`` envelope: a date inside the message wins over the header's, a level word over PRI."""
    d = lines.filter(F.col("raw").rlike(P.FORWARDED)).withColumn("_m", month_number(F.regexp_extract("raw", P.FORWARDED, 2)))
    d = with_year(d.filter("_m is not null"), F.lit(base_year) if isinstance(base_year, int) else base_year, "_m")
    g = {k: F.regexp_extract("raw", P.FORWARDED, k) for k in range(1, 7)}
    proc, pid, msg = process_parts(g[6])
    inside = F.try_to_timestamp(F.concat(F.regexp_extract(msg, P.EMBEDDED_TIME, 1), F.lit(" "), F.regexp_extract(msg, P.EMBEDDED_TIME, 2)))
    word = F.nullif(F.regexp_extract(msg, P.LEVEL_TOKEN, 1), F.lit(""))
    named = F.when(word.rlike("^(EMERG|ALERT|CRIT|FATAL)"), "CRIT").when(word.startswith("ERR"), "ERROR").when(word.startswith("WARN"), "WARN").when(word.isin("NOTICE") | word.startswith("INFO"), "INFO").when(word == "DEBUG", "DEBUG")
    pri = g[1].cast("int")
    by_pri = F.when(pri <= 191, lookup(dict(enumerate(P.FORWARDED_LEVELS)), F.pmod(pri, F.lit(8)))).otherwise("UNKNOWN")
    return finish(d, "forwarded", F.coalesce(inside, stamp(F.col("_year"), F.col("_m"), g[3], g[4])), F.coalesce(named, by_pri), g[5], msg, proc, pid)


def datagram(text: Column, sender: Column) -> Column:
    """(pri, facility, severity, host, host_given, message) of one syslog datagram in either format; without a host the
    sender stands in and ``host_given`` is false. For batch and streaming frames alike."""
    has = text.rlike(r"^<\d{1,3}>")
    pri = F.when(has, F.regexp_extract(text, r"^<(\d{1,3})>", 1).cast("int"))
    body = F.regexp_replace(text, r"^<\d{1,3}>", "")
    new = r"^\d\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|(?:\[[^\]]*\])+)\s*(.*)$"
    given = F.nullif(F.when(body.rlike(new), F.regexp_extract(body, new, 2)).when(body.rlike(P.RFC3164), F.regexp_extract(body, P.RFC3164, 4)), F.lit("-"))
    msg = F.when(body.rlike(new), F.regexp_extract(body, new, 6)).when(body.rlike(P.RFC3164), F.regexp_extract(body, P.RFC3164, 5)).otherwise(body)
    known = pri <= 191
    return F.struct(
        pri.alias("pri"), F.when(known, lookup(dict(enumerate(P.SYSLOG_FACILITIES)), F.floor(pri / 8).cast("int"))).alias("facility"),
        F.when(known, lookup(dict(enumerate(P.SYSLOG_SEVERITIES)), F.pmod(pri, F.lit(8)))).alias("severity"),
        F.coalesce(given, sender).alias("host"), given.isNotNull().alias("host_given"), msg.alias("message"),
    )


#: name -> parser; extend with register().
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "canonical": canonical, "rfc3164": rfc3164, "iso8601": iso8601, "rfc5424": rfc5424, "jsonlog": jsonlog, "logcat": logcat,
    "apache": apache, "zookeeper": log4j, "hadoop": log4j, "spark": log4j, "hdfs": log4j, "openstack": log4j, "bgl": bgl,
    "forwarded": forwarded, "thunderbird": thunderbird, "proxifier": proxifier, "windows_cbs": windows_cbs, "unknown": generic,
}


def register(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[name] = parser


def ingest(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Records of all runs, each by the parser of its sniffed format. ``formats`` has one row per run; only the names of
    the formats that occur reach the driver, and only their parsers are planned."""
    out: DataFrame | None = None
    present = {r["format"] for r in formats.select("format").distinct().collect()}
    tagged = lines.join(formats.withColumnRenamed("format", "_format"), "run_id")
    for name, parser in PARSERS.items():
        if name not in present and (out is not None or name != "unknown"):
            continue
        one = parser(tagged.filter(F.col("_format") == name)).select(*RECORD)
        out = one if out is None else out.unionByName(one)
    return out
