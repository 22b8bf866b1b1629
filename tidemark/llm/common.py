"""What several operators share: cutting lineage, scratch folders, state of a Python worker and word splitting."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a session on one machine may leave it unset (tests);
    it gets a temporary folder, removed when Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(sys, "_tidemark_shared", None)
        if not found:
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = sys._tidemark_shared = "file://" + folder
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Run df now and cut its lineage with a reliable checkpoint, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that are read more than once within an operator, then dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return memory that Python, Arrow and the C library hold but don't use; a worker lives through many stages."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_state(owner: str) -> dict:
    """A dictionary that outlasts a task in a Python worker. It belongs to one operator at a time: another one's caches are
    let go, so that a worker that serves many stages holds those of the last only."""
    owned = getattr(sys, "_tidemark_state", None)
    if owned is None or owned[0] != owner:
        sys._tidemark_state = owned = None
        gc.enable()
        give_back()
        owned = sys._tidemark_state = (owner, {})
    return owned[1]


class WordHashes(dict):
    """64-bit hash of a word in bytes, remembered; emptied when it holds too many words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes() -> WordHashes:
    return worker_state("words").setdefault("word_hashes", WordHashes())


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of size neighbouring words, given the words' hashes."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = mixed(out) + hashes[k : k + n]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def encoded(column) -> Iterator[bytes]:
    """The values of an Arrow string column in UTF-8, one at a time; null counts as empty."""
    import pyarrow as pa

    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py() or b""


#: Bytes of texts that a function works on at a time; batches that come with more are cut into slices.
SLICE_BYTES = 4 << 20


def sliced(batches, at: int = 0, limit: int = SLICE_BYTES):
    """Record batches, cut where the texts of column `at` pass limit bytes. A slice has one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows < 2 or batch.column(at).nbytes <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


#: Bytes of an Arrow batch between Spark and Python in a pipeline, either way.
BATCH_BYTES = 1 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df in a copy of its session, where Arrow batches end at BATCH_BYTES; what is derived from it runs there too, and df's own
    session keeps its settings. Spark's default is 64 MB a batch: each task fills buffers of that size, and what it frees stays with
    the executor's C library in pieces, a stage's beside the other's."""
    session, to_df = df.sparkSession, RDD.toDF
    own = SparkSession(session.sparkContext, session._jsparkSession.cloneSession())
    RDD.toDF = to_df  # creating a session ties this method to it
    limit = own._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(min(limit, BATCH_BYTES) if limit > 0 else BATCH_BYTES))
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()), own)


def in_pieces(batch, limit: int = BATCH_BYTES):
    """A record batch as slices of about limit bytes."""
    rows = max(1, batch.num_rows * limit // max(batch.nbytes, limit))
    for a in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(a, rows)


def require(df: DataFrame, *names: str) -> None:
    """Check that df has these columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}; there are {', '.join(df.columns)}")


def unused(columns: list[str], name: str) -> str:
    """A name like this one that is no column's, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_names(columns: list[str], *names: str) -> list[str]:
    """The columns that aren't named so, whatever the case of letters."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


#: Bytes that the rows of a side may hold to be broadcast, as measured before each broadcast.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, *sized: str) -> bool:
    """Whether df, which has been written or checkpointed, may be broadcast: its rows at 64 bytes each and the bytes of the
    columns `sized` (strings, or arrays and maps at 16 bytes an entry) are counted."""
    kinds = dict(df.dtypes)
    size = F.lit(64)
    for c in sized:
        size = size + F.coalesce(F.octet_length(c) if kinds[c] in ("string", "binary") else 16 * F.size(c), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def with_computed(df: DataFrame, text_col: str, keep: list[str], fn, schema: str) -> DataFrame:
    """The columns keep of df plus those that fn computes from the Arrow array of the text column, in whole batches.

    fn: iterator of (rows, text array) -> iterator of (rows, [arrays]), where rows is a list of Arrow arrays that it
    passes on unchanged, possibly for several batches joined. A kept column named like a computed one, whatever the case
    of letters, is left out. Batches come cut to SLICE_BYTES of text.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(schema)
    keep = without_names(keep, *new.names)
    # A kept text is sent to Python once: it is the text column itself.
    own = keep.index(text_col) if text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType) else -1
    slim = df.select(df[text_col].cast("string").alias("_text"), *[df[c].alias(f"_k{i}") for i, c in enumerate(keep) if i != own])

    def run(batches):
        import pyarrow as pa

        def pair(b):
            rows = b.columns[1:]
            return (rows if own < 0 else [*rows[:own], b.column(0), *rows[own:]]), b.column(0)

        for rows, made in fn(map(pair, sliced(batches))):
            yield from in_pieces(pa.RecordBatch.from_arrays([*rows, *made], names))
        give_back()  # the worker waits beside stages that need the memory

    out = T.StructType([T.StructField(f"_k{i}", df.schema[c].dataType, True) for i, c in enumerate(keep)] + list(new))
    names = out.names
    got = slim.mapInArrow(run, out)
    return got.select(*[got[f"_k{i}"].alias(c) for i, c in enumerate(keep)], *[got[n] for n in new.names])
