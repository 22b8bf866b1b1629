"""Compaction and retention policies as queries over file metadata.

A metadata row is (level, file_id, first_key, last_key, entries, size, created_at). Level 0 is the newest and may
overlap; its files are newest first by descending file_id. Deeper levels are ordered by first_key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec


@dataclass(frozen=True)
class Leveled:
    multiplier: int = 2
    max_levels: int = 3
    level0_threshold: int = 2
    base_bytes: int = 128 << 20


@dataclass(frozen=True)
class Tiered:
    hot_ttl_s: int
    max_hot: int
    small_bytes: int
    max_output_bytes: int
    cold_max_bytes: int
    cold_ttl_s: int | None = None


def run_metadata(rows: DataFrame) -> DataFrame:
    """Metadata of the files (level, file_id) that rows come from; needs key, size and created_at."""
    return rows.groupBy("level", "file_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"), F.sum("size").alias("size"), F.max("created_at").alias("created_at"))


def entry_size():
    """Bytes of an entry: two length fields, key and value."""
    return 4 + F.octet_length("key") + codec.byte_size(F.col("value"))


def overlapping(files: DataFrame, low, high) -> DataFrame:
    """Files whose key range meets [low, high]."""
    return files.where((F.col("first_key") <= high) & (F.col("last_key") >= low))


def overlap_pairs(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(upper_id, lower_id) of files with overlapping ranges. Metadata only: a row a file."""
    u = upper.select(F.col("file_id").alias("upper_id"), F.col("first_key").alias("lo"), F.col("last_key").alias("hi"))
    v = lower.select(F.col("file_id").alias("lower_id"), "first_key", "last_key")
    return u.join(v, (F.col("lo") <= F.col("last_key")) & (F.col("hi") >= F.col("first_key"))).select("upper_id", "lower_id")


def level0_task(files: DataFrame) -> DataFrame:
    """Compaction of level 0: all its files and those of level 1 that meet their joint range."""
    top = files.where("level = 0")
    span = top.agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    met = files.where("level = 1").join(span, (F.col("first_key") <= F.col("hi")) & (F.col("last_key") >= F.col("lo")))
    return top.select(F.lit("input").alias("side"), "file_id").unionByName(met.select(F.lit("overlap").alias("side"), "file_id"))


def lower_task(files: DataFrame, level: int) -> DataFrame:
    """Compaction of a deeper level: its first file by key, and those of the next level that meet it."""
    first = files.where(F.col("level") == level).orderBy("first_key", "file_id").limit(1)
    span = first.select(F.col("first_key").alias("lo"), F.col("last_key").alias("hi"))
    met = files.where(F.col("level") == level + 1).join(span, (F.col("first_key") <= F.col("hi")) & (F.col("last_key") >= F.col("lo")))
    return first.select(F.lit("input").alias("side"), "file_id").unionByName(met.select(F.lit("overlap").alias("side"), "file_id"))


def level_scores(files: DataFrame, options: Leveled) -> DataFrame:
    """(level, files, bytes, score): level 0 by its number of files, level k by its bytes against base * multiplier^(k-1)."""
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    target = F.lit(float(options.base_bytes)) * F.pow(F.lit(float(options.multiplier)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(options.level0_threshold))).otherwise(F.col("bytes") / target)
    return sums.withColumn("score", score)


def pick_level(files: DataFrame, options: Leveled) -> DataFrame:
    """The level to compact: 0 once it has its threshold of files, else the fullest level over its target; or none. The
    bottom level has no next one."""
    scores = level_scores(files, options).where(F.col("level") < options.max_levels)
    due = F.when(F.col("level") == 0, F.col("score") >= 1).otherwise(F.col("score") > 1)
    return scores.where(due).orderBy(F.col("level") != 0, F.col("score").desc(), "level").limit(1)


def aged(files: DataFrame, now) -> DataFrame:
    """Age in seconds; the windows below run over the files of a store's metadata, a row a file, not over its rows."""
    return files.withColumn("age", now.cast("timestamp").cast("double") - F.col("created_at").cast("double"))


def expired_prefix(files: DataFrame, options: Tiered, now) -> DataFrame:
    """Promote: from the oldest hot file on, those past the TTL, up to the first that isn't."""
    oldest = Window.partitionBy("level").orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0)
    hot = aged(files.where("level = 0"), now)
    return hot.withColumn("all_expired", F.min((F.col("age") >= options.hot_ttl_s).cast("int")).over(oldest)).where("all_expired = 1").select("file_id")


def expired_cold(files: DataFrame, options: Tiered, now) -> DataFrame:
    """Cold files past the cold TTL; none without one."""
    if options.cold_ttl_s is None:
        return files.limit(0).select("file_id")
    return aged(files.where("level >= 1"), now).where(F.col("age") >= options.cold_ttl_s).select("file_id")


def over_cap(files: DataFrame, options: Tiered) -> DataFrame:
    """Cold files to drop, deepest level first, until the rest fits the size cap."""
    cold = files.where("level >= 1").withColumn("_all", F.lit(1))
    total = Window.partitionBy("_all")
    before = total.orderBy(F.col("level").desc(), "first_key", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    walked = cold.withColumn("excess", F.sum("size").over(total) - F.lit(options.cold_max_bytes)).withColumn("freed", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return walked.where(F.col("freed") < F.col("excess")).select("file_id")


def small_run(files: DataFrame, options: Tiered) -> DataFrame:
    """Hot merge: if level 0 has too many files, the run of small ones from the oldest on that fits the output; two at least."""
    oldest = Window.partitionBy("level").orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0)
    hot = files.where("level = 0").withColumn("sum", F.sum("size").over(oldest)).withColumn("number", F.count(F.lit(1)).over(Window.partitionBy("level")))
    ok = (F.col("size") <= options.small_bytes) & (F.col("sum") <= options.max_output_bytes)
    run = hot.withColumn("ok", F.min(ok.cast("int")).over(oldest)).where((F.col("number") > options.max_hot) & (F.col("ok") == 1))
    return run.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("level"))).where("length >= 2").select("file_id")


def pick_tiered(files: DataFrame, options: Tiered, leveled: Leveled, now) -> DataFrame:
    """(action, file_id) of the first action in order of priority that has any file: Promote, ColdEvict by age, ColdEvict
    by size, HotMerge, ColdCompact."""
    cold = files.where("level >= 1")
    level = pick_level(cold, leveled).select("level")
    compacted = cold.join(level, "level", "left_semi").groupBy("level").agg(F.min(F.struct("first_key", "file_id")).alias("f")).select(F.col("f.file_id").alias("file_id"))
    ranked = [("Promote", expired_prefix(files, options, now)), ("ColdEvictTtl", expired_cold(files, options, now)), ("ColdEvictSize", over_cap(files, options)), ("HotMerge", small_run(files, options)), ("ColdCompact", compacted)]
    every = None
    for k, (action, rows) in enumerate(ranked):
        part = rows.select(F.lit(k).alias("rank"), F.lit(action).alias("action"), "file_id")
        every = part if every is None else every.unionByName(part)
    best = every.agg(F.min("rank").alias("rank"))
    return every.join(F.broadcast(best), "rank", "left_semi").select("action", "file_id")


def applied(files: DataFrame, gone: DataFrame, made: DataFrame) -> DataFrame:
    """Metadata after a compaction: the inputs out, the outputs in."""
    return files.join(gone.select("file_id"), "file_id", "left_anti").select(*files.columns).unionByName(made.select(*files.columns))
