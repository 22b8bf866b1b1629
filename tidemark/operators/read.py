"""Point and range reads. Key bounds are put below the merge, where Parquet statistics and filters can use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import live


def literal(key: bytes | Column) -> Column:
    return key if isinstance(key, Column) else F.lit(bytes(key))


def get(log: DataFrame, key: bytes | Column) -> DataFrame:
    """The live row of one key, or none."""
    return live(log.where(F.col("key") == literal(key)))


def scan(log: DataFrame, start: bytes | Column, end: bytes | Column) -> DataFrame:
    """Live rows with start <= key <= end in key order; none if start > end."""
    return live(log.where(F.col("key").between(literal(start), literal(end)))).orderBy("key")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Extension: the live rows of many keys, a table with a column key."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi"))
