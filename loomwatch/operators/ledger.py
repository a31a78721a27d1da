"""Hash chains: verification of an audit ledger, and rebuilding of what derives from it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def canonical_json(columns: list[str]) -> Column:
    """Flat columns as JSON with sorted keys, no spaces and nulls kept: the bytes that get hashed."""
    quote = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", ""))
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), quote(c)) for c in sorted(columns))), F.lit("}"))


def canonical_text(text: Column) -> Column:
    """A JSON text of any depth in the form that gets hashed: keys sorted by code point at every level, no spaces, characters as themselves, numbers as a
    double or an integer of any size prints. Of equal keys the last wins; null and text that is not JSON give null. Arrow batches, a parse per row."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)


def verify_chain(entries: DataFrame, ledger: str, seq: str, prev: str, entry: str, recomputed: Column) -> DataFrame:
    """Per ledger: entries, ok, first_break (its sequence number) and reason. Order is one per ledger, so the window is partitioned
    by ledger."""
    before = F.lag(entry).over(W.partitionBy(ledger).orderBy(seq))
    first = F.row_number().over(W.partitionBy(ledger).orderBy(seq)) == 1
    d = entries.withColumn("_before", before).withColumn("_first", first).withColumn("_hash", recomputed)
    reason = F.when(F.col(entry) != F.col("_hash"), "hash mismatch").when(~F.col("_first") & ~F.col(prev).eqNullSafe(F.col("_before")), "broken link")
    d = d.withColumn("_reason", reason)
    broken = F.col("_reason").isNotNull()
    return d.groupBy(ledger).agg(
        F.count("*").alias("entries"), (F.count_if(broken) == 0).alias("ok"), F.min(F.when(broken, F.col(seq))).alias("first_break"),
        F.min_by("_reason", F.when(broken, F.col(seq))).alias("reason"),
    )


def audit_index(entries: DataFrame, verdict: DataFrame, ledger: str, columns: list[str]) -> DataFrame:
    """Index rows of ledgers whose chain holds; a broken chain gives none."""
    return entries.join(verdict.filter("ok").select(ledger), ledger, "left_semi").select(ledger, *columns)
