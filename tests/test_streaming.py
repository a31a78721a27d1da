import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomwatch.sources import growing
from loomwatch.sources.lines import file_encodings
from loomwatch.streaming import live


def test_stateful_peak_over_batches_equals_batch(spark, tmp_path):
    rows = [(k % 3, 1_000_000 * (k * k % 97)) for k in range(120)]
    src = tmp_path / "in"
    for part in range(4):
        chunk = sorted(rows, key=lambda r: r[1])[part * 30 : part * 30 + 30]
        spark.createDataFrame(chunk, "source long, us long").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("source long, us long").option("maxFilesPerTrigger", 1).parquet(str(src))
    live.run_to_end(live.peak_failures(s, 20_000_000), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {r.source: (r.f, r.p) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("source").agg(F.max("failures").alias("f"), F.max("peak").alias("p")).collect()}
    want = {}
    for k in range(3):
        t = sorted(us for s_, us in rows if s_ == k)
        want[k] = (len(t), max(sum(x - 20_000_000 <= y <= x for y in t) for x in t))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] <= want[k][1] for k in got)


def test_tail_and_recent_rules(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    (src / "a.log").write_text("error one\n???\nerror two\n")
    lines = live.tail(spark, str(src)).withColumn("n", F.regexp_extract("raw", r"(\d*)$", 1).cast("long"))
    live.run_to_end(lines.drop("n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["???", "error one", "error two"]
    (src / "b.log").write_text("later\n")
    live.run_to_end(lines.drop("n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    recs = tmp_path / "recs"
    for b in range(2):
        spark.createDataFrame([("r", b * 10 + k, f"{'error' if k % 2 else 'ok'} {k}") for k in range(4)], "run_id string, n long, raw string").coalesce(1).write.mode("append").parquet(str(recs))
    s = spark.readStream.schema("run_id string, n long, raw string").option("maxFilesPerTrigger", 1).parquet(str(recs))
    live.run_to_end(live.recent_rules(s, [("err", "error"), ("none", "zzz")], keep=5), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = spark.read.parquet(str(tmp_path / "o2")).orderBy("batch").collect()
    assert [r.rule for r in got] == ["err", "err"] and re.match("err", got[0].rule) and got[0].hits == 2


def test_quality_counts(spark):
    d = spark.createDataFrame([(1, True), (1, False), (2, False)], "k int, bad boolean")
    r = live.quality_counts(d, "bad", "k").first()
    assert (r.received, r.unparsed, r.duplicates) == (3, 1, 1)


def test_sessions_close(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=m), "a") for m in (0, 30, 61, 600)]
    spark.createDataFrame(rows, "ts timestamp, e string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, e string").parquet(str(tmp_path / "in"))
    live.run_to_end(live.sessions(s, "ts", "e", 1800, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.first, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(t0, 2), (t0 + timedelta(minutes=61), 1)]


def _follow(spark, tmp_path, tag="f"):
    lines = growing.followed_lines(spark, str(tmp_path / "logs"), 16)
    live.run_to_end(lines, str(tmp_path / f"out-{tag}"), str(tmp_path / f"cp-{tag}"))
    return sorted((r.run_id.rsplit("/", 1)[1], r.n, r.raw) for r in spark.read.parquet(str(tmp_path / f"out-{tag}")).collect())


def test_followed_files_grow_are_cut_off_and_replaced(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    a = tmp_path / "logs" / "a.log"
    a.write_text("one\n\ntwo is rather long for a split\npart")
    want = [("a.log", 0, "one"), ("a.log", 4, ""), ("a.log", 5, "two is rather long for a split")]
    assert _follow(spark, tmp_path) == want
    assert _follow(spark, tmp_path) == want  # nothing new
    with a.open("a") as f:
        f.write("ial\r\n")
    (tmp_path / "logs" / "b.log").write_bytes("﻿zwei\nü\n".encode("utf-16-le"))
    want += [("a.log", 36, "partial"), ("b.log", 0, "zwei"), ("b.log", 12, "ü")]
    assert _follow(spark, tmp_path) == sorted(want)
    a.write_text("one\n")  # cut off
    want.append(("a.log", 0, "one"))
    assert _follow(spark, tmp_path) == sorted(want)
    a.write_text("other first line\nand more than before\n")  # replaced by a longer one
    want += [("a.log", 0, "other first line"), ("a.log", 17, "and more than before")]
    assert _follow(spark, tmp_path) == sorted(want)


def test_decoded_lines_number_every_encoding(spark, tmp_path):
    texts = {"u8": ("utf-8", "é one\n\nthree\r\nlast"), "w": ("cp1252", "café “q”\nb\n"), "le": ("utf-16-le", "﻿abĊ\nc\n"), "be": ("utf-16-be", "﻿x\ny")}
    (tmp_path / "in").mkdir()
    for name, (codec, text) in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode(codec))
    (tmp_path / "in" / "empty").write_bytes(b"")
    for size in (2, 8, 1 << 20):
        got = sorted((r.run_id.rsplit("/", 1)[1], r.n, r.raw) for r in growing.decoded_lines(spark, str(tmp_path / "in"), size).collect())
        want = [(k, n + 1, x.removesuffix("\r")) for k, (_, t) in texts.items() for n, x in enumerate(t.removeprefix("﻿").removesuffix("\n").split("\n"))]
        assert got == sorted(want), size
    enc = {r.run_id.rsplit("/", 1)[1]: r.encoding for r in file_encodings(spark, str(tmp_path / "in")).collect()}
    assert enc == {"u8": "utf-8", "w": "windows-1252", "le": "utf-16le", "be": "utf-16be"}


def test_peak_state_expires_into_a_new_episode(spark, tmp_path):
    minute = 60_000_000
    for k, us in enumerate([0, minute, 500 * minute, 501 * minute]):  # a long pause after the second
        spark.createDataFrame([(1, us), (2, 500 * minute if us == minute else us)], "source long, us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    for k in range(4):
        s = spark.readStream.schema("source long, us long").parquet(str(tmp_path / "in" / f"[0-{k}]"))
        live.run_to_end(live.peak_failures(s, 5 * minute, idle_us=60 * minute), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("source", "since").agg(F.max("failures").alias("f"), F.max("peak").alias("p"))
    assert sorted((r.since, r.f, r.p) for r in got.filter("source = 1").collect()) == [(0, 2, 2), (500 * minute, 2, 2)]


def test_progress_counts_late_rows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    for k, hours in enumerate([(0, 1), (100, 101), (2, 102)]):  # the 2 comes after the watermark
        spark.createDataFrame([(h, t0 + timedelta(hours=h), h % 2 == 1) for h in hours], "k int, ts timestamp, bad boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    rows = []
    for k in range(3):
        s = spark.readStream.schema("k int, ts timestamp, bad boolean").parquet(str(tmp_path / "in" / f"[0-{k}]"))
        rows += live.progress_rows(live.run_to_end(live.dedupe(live.counted(s, "bad"), "ts", ("k",)), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert [r[1:] for r in rows] == [(2, 1, 0), (2, 1, 0), (2, 0, 1)]
