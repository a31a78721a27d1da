"""Exact time arithmetic in integer microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds(n: float) -> int:
    return int(n * 1_000_000)
