"""Sharding by a two-pass external shuffle.

Every row has a seeded hash of all its columns, so its place depends on the seed and the rows only, not on partitioning or
the order of fetches, and a task that is run again after a lost executor writes the same rows.

Pass one counts equal hashes, a narrow row a hash: that gives rows and bytes in all, the rows of each partition, and the
rows that have very many copies. Pass two scatters the rows uniformly into partitions, and within a partition into
memory-sized buckets, by their hashes; Spark sorts a partition by bucket and spills as it needs, and a task takes one
bucket at a time, puts it into an order by a second hash, applies a Fisher-Yates shuffle seeded by job and bucket, and
writes it. Buckets follow each other, so a row's place in the whole order is the offset of its partition (there are at most
PARTITIONS of them) plus its place there; shard s of n takes the places from ceil(s * rows / n) on. Shards so differ by one
row at most (the law `rows`), and slots have no gaps.

Copies of one row that together take more than a part of a bucket don't share one: they are counted where they lie, made
again from the count in slices, and each copy is dealt by a hash of its own number. There are at most MANY such rows, as
each takes more than a MANY-th of all bytes.

Defined results: a null text counts as empty for sizes and stays null in the files; texts of any length are moved whole;
repeated rows each get a slot of their own; columns of docs named `shard` or `slot`, whatever the case, are left out, all
others are kept; an empty table gives an empty one. Columns with maps inside have no part in the hash, and tables that
have one deal the copies of a row like other rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, require, without_names

BUCKET_BYTES = 24 << 20
ROW_BYTES = 64  # what a row takes besides its text
#: Bytes of a partition up to the number of PARTITIONS; beyond it partitions take more buckets.
PARTITION_BYTES, PARTITIONS = 64 << 20, 20_000
#: Rows with copies of their own hashes at most, and copies that a task makes at a time.
MANY, SLICE = 500_000, 100_000


def seeded(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def shuffled(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """All columns of docs, and `shard` and `slot`."""
    require(docs, id_col, text_col)
    kept = without_names(docs.columns, "shard", "slot")
    names = [f"_c{i}" for i in range(len(kept))]
    hashed = [docs[c] for c in kept if not has_map(docs.schema[c].dataType)]
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)) + ROW_BYTES
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(kept, names)], seeded(seed, *hashed).alias("_h"), size.cast("long").alias("_n"))
    sums = cut(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("k"), F.max("_n").alias("n")))
    total = sums.agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
    parts = max(1, min(PARTITIONS, -(-total // partition_bytes)))
    buckets = max(1, -(-total // (parts * bucket_bytes)))
    hot = None
    if len(hashed) == len(kept):
        hot = sums.where((F.col("k") > 1) & (F.col("k") * F.col("n") > max(bucket_bytes // 4, total // MANY))).select("_h", "k")
        hot = None if hot.isEmpty() else hot

    def slices(copies: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), (copies - 1).cast("long"), F.lit(SLICE).cast("long")))

    def copied(some: DataFrame) -> DataFrame:
        """k rows for each of `some`, in the place of their hash one of their own number; made in slices, by many tasks."""
        cells = some.withColumn("_at", slices(F.col("k"))).repartition("_h", "_at")
        each = cells.withColumn("_copy", F.explode(F.sequence("_at", F.least(F.col("_at") + SLICE, F.col("k")) - 1)))
        return each.withColumn("_h", F.xxhash64(F.lit(seed), "_h", "_copy")).drop("k", "_at", "_copy")

    part = F.pmod(F.col("_h"), F.lit(parts)).cast("int").alias("p")
    if hot is None:
        counts = sums.groupBy(part).agg(F.sum("k").alias("k"))
    else:
        others = sums.join(F.broadcast(hot.select("_h")), "_h", "left_anti").groupBy(part).agg(F.sum("k").alias("k"))
        counts = others.unionByName(copied(hot).groupBy(part).agg(F.count(F.lit(1)).alias("k"))).groupBy("p").agg(F.sum("k").alias("k"))
        alone = rows.join(F.broadcast(hot.select("_h")), "_h", "left_anti")
        group = rows.join(F.broadcast(hot.select("_h")), "_h", "left_semi").groupBy("_h", *names).agg(F.count(F.lit(1)).alias("k"))
        rows = alone.drop("_n").unionByName(copied(group))
    held = {r.p: r.k for r in counts.collect()}  # a row a partition, PARTITIONS at most
    each = np.array([held.get(p, 0) for p in range(parts)], np.int64)
    n = int(each.sum())
    shipped = docs.sparkSession.sparkContext.broadcast((np.cumsum(each) - each, np.array([-(-s * n // shards) for s in range(shards)], np.int64)))
    out = T.StructType([T.StructField(x, docs.schema[c].dataType, True) for c, x in zip(kept, names)] + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    order = F.xxhash64(F.lit(seed + 1), "_h")
    bucket = F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "_h"), 1), F.lit(buckets)).cast("int")
    keyed = rows.select(part.alias("_p"), bucket.alias("_b"), order.alias("_g"), *names)
    scattered = keyed.repartitionById(parts, F.col("_p")).sortWithinPartitions("_p", "_b", "_g")

    def deal(batches):
        offset, firsts = shipped.value
        place, key, held = 0, None, []

        def bucket():
            """The bucket held, shuffled."""
            nonlocal place
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            at = np.arange(table.num_rows)
            rng = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, *key]))
            for i, j in zip(range(len(at) - 1, 0, -1), (rng.random(max(0, len(at) - 1)) * np.arange(len(at), 1, -1)).astype(np.int64)):
                at[i], at[j] = at[j], at[i]
            places = place + np.arange(len(at))
            place += len(at)
            shard = np.searchsorted(firsts, places, side="right") - 1
            table = table.take(pa.array(at)).select(names)
            return table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(places - firsts[shard], pa.int64())).to_batches()

        for batch in batches:
            p, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(b) != 0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                mine = (int(p[a]), int(b[a]))
                if mine != key:
                    if held:
                        yield from bucket()
                    if key is None or key[0] != mine[0]:
                        place = int(offset[mine[0]])
                    key = mine
                held.append(batch.slice(a, z - a))
        if held:
            yield from bucket()

    dealt = scattered.mapInArrow(deal, out)
    return dealt.select(*[F.col(x).alias(c) for c, x in zip(kept, names)], "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> DataFrame:
    """Write the shuffled rows as Parquet, a folder shard=N for each shard, and read them back."""
    shuffled(docs, shards, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
    schema = T.StructType([docs.schema[c] for c in without_names(docs.columns, "shard", "slot")] + [T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)
