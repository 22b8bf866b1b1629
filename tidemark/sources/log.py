"""The write-ahead log as rows, and its replay up to the first damaged entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import latest_wins


def checksum(op: Column, key: Column, value: Column) -> Column:
    """CRC-32 over operation, key and value."""
    return F.crc32(F.concat(op.cast("binary"), F.lit(b"\x00"), key, F.lit(b"\x00"), F.coalesce(value, F.lit(b""))))


def intact(entries: DataFrame, good: Column, log: str = "memtable_id", order: str = "pos") -> DataFrame:
    """Of each log the entries before its first bad one. The first bad place is an aggregate of a row a log, so logs of
    any length are cut without sorting."""
    bad = entries.where(~F.coalesce(good, F.lit(False))).groupBy(log).agg(F.min(order).alias("_bad"))
    met = entries.join(bad, log, "left")
    return met.where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def replay(entries: DataFrame, good: Column) -> DataFrame:
    """The newest intact operation of each key; recency is (memtable_id, pos)."""
    ordered = intact(entries, good).withColumn("seq", F.struct("memtable_id", "pos"))
    return latest_wins(ordered.select("key", "seq", "op", "value"))
