"""Structured Streaming: tailing, ingest dedupe, sessions, stateful brute force, rules over recent records, ingest quality.

Every query bounds its state: by a watermark, or by what it keeps per key. Batch results are the reference answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwatch.sources.envelopes import PARSERS
from loomwatch.sources.lines import SNIFFERS
from loomwatch.sources.sinks import event_hash

#: Event time runs this much ahead where a watermark is kept: a stream's first watermark is the epoch, and rows at or before it would count as late.
SHIFT_US = 1 << 52


def tail(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(run_id, raw): every line of new files once; lines are not filtered, so that unparsable ones can be reported."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("raw"))


def dedupe(stream: DataFrame, ts: str, keys: tuple[str, ...], delay: str = "10 minutes") -> DataFrame:
    """Each event hash once within the watermark."""
    return stream.withColumn("event_hash", event_hash(*keys)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_hash"])


def sessions(stream: DataFrame, ts: str, entity: str, gap_seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """Sessions of an entity; the gap is inclusive, hence one microsecond more than asked."""
    gap = F.session_window(ts, f"{gap_seconds} seconds 1 microsecond")
    return stream.withWatermark(ts, delay).groupBy(gap.alias("w"), entity).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def peak_failures(failures: DataFrame, window_us: int, entity_type: str = "long", idle_us: int = 86_400_000_000, delay: str = "10 minutes") -> DataFrame:
    """Per source, episode (``since``, its first time) and micro-batch: failures so far and the peak in any trailing window, exactly.

    In: (source, us). State holds the times of one window and goes ``idle_us`` (at least the window) after a source's last failure, by event time: what comes
    later begins a new episode, so that totals are sums over episodes and peaks their maximum. Rows later than the watermark are dropped and counted in the
    query's progress (``progress_rows``); other late rows count, for the peak as of their place among the times still held."""
    out = f"source {entity_type}, since long, failures long, peak long"
    idle_ms = -(-max(idle_us, window_us) // 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, n, peak, times = state.get if state.exists else (None, 0, 0, [])
        new = [t for b in batches for t in b["us"].tolist()]
        times = sorted(list(times) + new)
        lo = 0
        for hi, t in enumerate(times):
            while times[lo] < t - window_us:
                lo += 1
            peak = max(peak, hi - lo + 1)
        since = times[0] if since is None else since
        state.update((since, n + len(new), peak, [t for t in times if t >= times[-1] - window_us]))
        state.setTimeoutTimestamp(max((times[-1] + SHIFT_US) // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source": [key[0]], "since": [since], "failures": [n + len(new)], "peak": [peak]})

    timed = failures.filter("us is not null").withColumn("_ts", F.timestamp_micros(F.col("us") + SHIFT_US)).withWatermark("_ts", delay)
    return timed.groupBy("source").applyInPandasWithState(step, out, "since long, n long, peak long, times array<long>", "update", "EventTimeTimeout")


def recent_rules(records: DataFrame, patterns: list[tuple[str, str]], keep: int = 500, idle_ms: int = 86_400_000) -> DataFrame:
    """(run_id, rule, hits, first_n): rules over the last ``keep`` records of a run, told again when their evidence changes.

    Spark matches the patterns (as in batch queries); state holds a record's number and the rules that it met, not its text, and goes ``idle_ms`` after a
    run's last record arrived. Time of arrival is the watermark's time (unparsed records have no other), so that a query that runs to its end ends."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, told = ([(int(n), list(m)) for n, m in state.get[0]], dict(zip(state.get[1], state.get[2]))) if state.exists else ([], {})
        last = 0
        for b in batches:
            last = max(last, int(b["_at"].max().timestamp() * 1000))
            held += zip(b["n"].tolist(), ([int(k) for k in m] for m in b["met"]))
        held = sorted(held)[-keep:]
        out = []
        for k, (rule, _) in enumerate(patterns):
            hits = [n for n, met in held if k in met]
            mark = f"{len(hits)}:{hits[0]}:{hits[-1]}" if hits else ""
            if hits and told.get(rule) != mark:
                out.append((key[0], rule, len(hits), hits[0]))
                told[rule] = mark
        state.update((held, list(told), list(told.values())))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["run_id", "rule", "hits", "first_n"])

    met = F.array_compact(F.array(*(F.when(F.col("raw").rlike("(?i)" + rx), F.lit(k)) for k, (_, rx) in enumerate(patterns))))
    timed = records.select("run_id", "n", met.cast("array<int>").alias("met"), F.current_timestamp().alias("_at")).withWatermark("_at", "1 minute")
    return timed.groupBy("run_id").applyInPandasWithState(
        step, "run_id string, rule string, hits long, first_n long", "held array<struct<n:long,met:array<int>>>, rules array<string>, marks array<string>", "append", "EventTimeTimeout"
    )


def records_or_unknown(lines: DataFrame, formats: list[str]) -> DataFrame:
    """(run_id, n, level, format, raw): every line once, by the first of ``formats`` whose pattern it meets; a line of none, or that its parser does not take, has
    level UNKNOWN. For streams and batches alike, without a join: each line passes one parser. In a stream, formats without a year (rfc3164, forwarded), whose
    rollover needs the whole run, are left to the batch."""
    looks = {name: rx for name, rx, _ in SNIFFERS}
    choice = F.coalesce(*(F.when(F.col("raw").rlike(looks[f]), f) for f in formats))
    tagged = lines.withColumn("_format", choice)
    out = tagged.filter("_format is null").select("run_id", "n", F.lit("UNKNOWN").alias("level"), F.lit("unknown").alias("format"), "raw")
    for f in formats:
        mine = PARSERS[f](tagged.filter(F.col("_format") == f))
        out = out.unionByName(mine.select("run_id", "n", F.coalesce("level", F.lit("UNKNOWN")).alias("level"), F.lit(f).alias("format"), "raw"))
    return out


def quality_counts(batch: DataFrame, unparsed: str, key: str) -> DataFrame:
    """Of a micro-batch: received, unparsed and duplicate rows; for foreachBatch."""
    return batch.agg(F.count("*").alias("received"), F.count_if(F.col(unparsed)).alias("unparsed"), (F.count(key) - F.count_distinct(key)).alias("duplicates"))


def counted(stream: DataFrame, unparsed: str, name: str = "quality") -> DataFrame:
    """The stream itself; its rows and unparsed rows are counted on the way and arrive in the query's progress."""
    return stream.observe(name, F.count(F.lit(1)).alias("received"), F.count_if(F.col(unparsed)).alias("unparsed"))


def progress_rows(query: StreamingQuery, name: str = "quality") -> list[tuple[int, int, int, int]]:
    """(batch, received, unparsed, dropped) of the micro-batches that the query still remembers (spark.sql.streaming.numRecentProgressUpdates): rows counted by
    ``counted`` and rows that came after the watermark, over all stateful operators."""
    out = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(name) if p.observedMetrics else None
        if seen is not None and p.numInputRows:
            out.append((p.batchId, seen["received"], seen["unparsed"], sum(s.numRowsDroppedByWatermark for s in p.stateOperators)))
    return out


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all there is and writes every micro-batch's rows as Parquet with the number of the batch; gives the ended query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return q
