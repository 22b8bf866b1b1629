"""The manifest: a log of metadata records, folded to the state of a store by set operations.

A record is (pos, kind, id, input_level, next_level, inputs, overlapping, outputs, ts); kinds are NewMemtable, Flush,
CompactionStart and CompactionResult.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDS = T.ArrayType(T.LongType())
RECORD = (
    T.StructType()
    .add("pos", T.LongType())
    .add("kind", T.StringType())
    .add("id", T.LongType())
    .add("input_level", T.IntegerType())
    .add("next_level", T.IntegerType())
    .add("inputs", _IDS)
    .add("overlapping", _IDS)
    .add("outputs", _IDS)
    .add("ts", T.TimestampType())
)


def unflushed(records: DataFrame) -> DataFrame:
    """Buffers that were opened and never flushed, in order of age: their logs are to be replayed."""
    made = records.where("kind = 'NewMemtable'").select("id").distinct()
    done = records.where("kind = 'Flush'").select("id")
    return made.join(done, "id", "left_anti")


def next_id(records: DataFrame) -> DataFrame:
    """One more than any id the records mention; 1 for an empty log."""
    most = F.greatest(F.coalesce("id", F.lit(0)), F.coalesce(F.array_max("outputs"), F.lit(0)), F.coalesce(F.array_max("inputs"), F.lit(0)), F.coalesce(F.array_max("overlapping"), F.lit(0)))
    return records.agg((F.coalesce(F.max(most), F.lit(0)) + 1).alias("next_id"))


def live_files(records: DataFrame) -> DataFrame:
    """(file_id, level) of the files that the log leaves: the last record that mentions a file decides."""
    flushed = records.where("kind = 'Flush'").select("pos", F.col("id").alias("file_id"), F.lit(0).alias("level"), F.lit(True).alias("alive"))
    results = records.where("kind = 'CompactionResult'")
    gone = results.select("pos", F.explode(F.concat(F.coalesce("inputs", F.array().cast("array<bigint>")), F.coalesce("overlapping", F.array().cast("array<bigint>")))).alias("file_id"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("alive"))
    made = results.select("pos", F.explode("outputs").alias("file_id"), F.col("next_level").alias("level"), F.lit(True).alias("alive"))
    said = flushed.unionByName(gone).unionByName(made)
    # An output may reuse an input's id within one record (a move); it then lives.
    last = said.groupBy("file_id").agg(F.max(F.struct("pos", "alive", "level")).alias("s"))
    return last.where("s.alive").select("file_id", F.col("s.level").alias("level"))
