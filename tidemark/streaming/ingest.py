"""Streams of changes: the latest view as streaming state, and ingest into a store by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import Leveled, Tiered
from ..sources.store import KVStore


def latest_stream(changes: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate (complete or update mode). Late or repeated changes do no
    harm: the greatest seq wins in any order."""
    rest = [c for c in changes.columns if c not in ("key", "seq")]
    best = changes.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("x"))
    return best.select("key", "seq", *[F.col(f"x.{c}").alias(c) for c in rest])


def ingest(changes: DataFrame, store: KVStore, checkpoint: str, compact_every: int = 8, options: Leveled | Tiered | None = None, lateness: int | None = None, **trigger) -> StreamingQuery:
    """Write a stream of (key, seq, op, value) to a store: each micro-batch is logged and flushed to a run of level 0, and
    every few batches one compaction step is taken. A batch that comes again after a failure is merged away, since the
    same rows win with the same values. lateness: how far in seq a change may come behind the newest one seen; what comes
    later is left out, and in return merges can drop old deletes. Without it all deletes are kept."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write_log(batch, late="raise" if lateness is None else "drop")
            store.flush()
            if lateness is not None:
                store.advance(store.state.next_seq - 1 - lateness)
        if number % compact_every == compact_every - 1:
            while store.compact(options):
                pass

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
