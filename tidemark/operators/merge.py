"""Merging versions and runs: the newest row of each key wins, and a newest delete hides the key.

Deletes are filtered only after the global choice, never within a run, so an older version can't come back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import DELETE, PUT

FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType)


def latest_wins(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The newest row of each key.

    Columns of fixed width take a hash aggregate with map-side combine (max_by), so only one row a key and task is
    shuffled, however hot the key. Others take a rank over each key, which Spark also limits before the shuffle.
    """
    rest = [c for c in log.columns if c not in (key, order)]
    if all(isinstance(log.schema[c].dataType, FIXED) for c in rest):
        return log.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest]).select(*log.columns)
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def is_put() -> Column:
    return F.col("op") == PUT


def live(log: DataFrame) -> DataFrame:
    """Newest versions that aren't deletes."""
    return latest_wins(log).where(is_put())


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """k-way merge of runs, newest first; recency is (position of the run, seq). Deletes pass through."""
    if not runs:
        raise ValueError("no runs to merge")
    tagged = [r.withColumn("_tier", F.lit(-k)) for k, r in enumerate(runs)]
    both = reduce(DataFrame.unionByName, tagged)
    newest = Window.partitionBy("key").orderBy(F.col("_tier").desc(), F.col("seq").desc())
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_tier")


def two_way_merge(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Two runs with one row a key each; on equal keys the newer side's row, a delete too."""
    a = newer.select("key", F.struct(*[c for c in newer.columns if c != "key"]).alias("_a"))
    b = older.select("key", F.struct(*[newer.columns[i] for i in range(len(newer.columns)) if newer.columns[i] != "key"]).alias("_b"))
    met = a.join(b, "key", "full").withColumn("_row", F.when(F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("_b")))
    return met.select("key", *[F.col(f"_row.{c}").alias(c) for c in newer.columns if c != "key"])


def bad_neighbours(files: DataFrame) -> DataFrame:
    """Neighbouring files of a level whose key ranges overlap; no row means that the level's runs can be concatenated."""
    by_key = Window.partitionBy("level").orderBy("first_key", "file_id")
    checked = files.withColumn("before", F.lag("last_key").over(by_key)).withColumn("before_id", F.lag("file_id").over(by_key))
    return checked.where(F.col("before") >= F.col("first_key")).select("level", F.col("before_id").alias("left_id"), F.col("file_id").alias("right_id"))


def concat_runs(runs: list[DataFrame], ranges: list[tuple[bytes, bytes]]) -> DataFrame:
    """Concatenation of runs whose key ranges (first, last) are disjoint and in order."""
    if not runs:
        raise ValueError("no runs to concatenate")
    for (_, last), (first, _) in zip(ranges, ranges[1:]):
        if last >= first:
            raise ValueError("runs overlap or are out of order")
    return reduce(DataFrame.unionByName, runs)


def compact(runs: list[DataFrame], bottom: bool) -> DataFrame:
    """One run for several. Deletes go only at the bottom, where no older run can hold their keys; rows keep their seq."""
    merged = latest_wins(reduce(DataFrame.unionByName, runs))
    return merged.where(is_put()) if bottom else merged


__all__ = ["DELETE", "PUT", "bad_neighbours", "compact", "concat_runs", "is_put", "latest_wins", "live", "merge_runs", "two_way_merge"]
