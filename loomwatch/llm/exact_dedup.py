"""Exact dedup by a tree merge of sorted digest runs, with DataFrame functions only.

Every text is reduced to a digest of its normalised form (all white space of ``[\\x20\\x09-\\x0D]`` deleted).
The rows are dealt into 2^R runs. In each binomial round, 2^fan_in neighbouring runs merge: rows of equal
digest collapse to the one that stays (most code points, then smallest doc_id, then first row) and their count. After the
last round one run is left, spread by digest over all tasks, so neither a hot group nor the last level
meets in one task: a digest has at most one row per run in every round.

Verification: two rows are equal only if SHA-256, a second independent 64-bit hash and the normalised
length all agree at every level.

Defined results: null text counts as empty; empty texts are equal to each other; ties in length go to the
smallest doc_id, a null one last; a repeated or null doc_id stays as several rows, each with the group's outcome.
Rows are told apart by a number of their own, so exactly one row of a group carries ``kept``, whatever the ids; an empty table
gives no rows; extra columns, whatever their names, are ignored (``exact_dedup``) or passed through (``keep_distinct``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.common import WS, materialise, with_rows

KEY = ["_sha", "_h64", "_len"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, _sha, _h64, _len, _points, _row): fixed-width digests of the normalised text, its size before, and the row's number.
    Without ``row`` the rows are numbered here; the result is then to be written before it is read twice."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(raw, WS, "")
    number = F.monotonically_increasing_id() if row is None else row
    return docs.select(F.col(id_col).alias("doc_id"), F.length(raw).cast("long").alias("_points"), norm.alias("_n"), number.alias("_row")).select(
        "doc_id", "_points", "_row", F.unhex(F.sha2("_n", 256)).alias("_sha"), F.xxhash64("_n").alias("_h64"),
        F.length("_n").cast("long").alias("_len"),
    )


def _best() -> Column:
    """Most code points first, then the smallest id (null last), then the first row: the smallest struct."""
    return F.min(F.struct("_neg", F.col("_id").isNull().alias("_no_id"), "_id", "_row"))


def merge_runs(runs: DataFrame, levels: int = 6, fan_in: int = 3) -> DataFrame:
    """Merges 2^levels runs in rounds of 2^fan_in. Out: KEY, _best(_neg, _no_id, _id, _row), _size."""
    level = runs.select(
        *KEY, (-F.col("_points")).alias("_neg"), F.col("doc_id").alias("_id"), "_row", F.lit(1).cast("long").alias("_size"),
        F.pmod(F.xxhash64("_row"), F.lit(1 << levels)).cast("int").alias("_run"),
    )
    level = level.groupBy("_run", *KEY).agg(_best().alias("_best"), F.sum("_size").alias("_size"))
    left = levels
    while left > 0:
        step = min(fan_in, left)
        left -= step
        level = (
            level.withColumn("_run", F.shiftright("_run", step))
            .groupBy("_run", *KEY)
            .agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"))
        )
    return level.drop("_run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 6, fan_in: int = 3) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return verdicts(materialise(digests(docs, id_col, text_col)), levels, fan_in).drop("_row")


def verdicts(d: DataFrame, levels: int = 6, fan_in: int = 3) -> DataFrame:
    """The rows of ``exact_dedup`` with their number ``_row``, from written digests."""
    winners = merge_runs(d, levels, fan_in).select(
        *KEY, F.col("_best._id").alias("keep_id"), F.col("_best._row").alias("_keep_row"), F.col("_size").alias("group_size")
    )
    return d.join(winners, KEY).select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), "_row",
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    rows, row = with_rows(docs)
    gone = verdicts(materialise(digests(rows, id_col, text_col, F.col(row)))).filter(~F.col("kept")).select(F.col("_row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
