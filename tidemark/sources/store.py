"""A key-value store on Parquet: a write-ahead log, changelog batches, sorted runs, and an atomically published manifest.

Layout of a store's folder: `runs/<id>` (Parquet, sorted by key, with statistics and a Bloom filter on the key), `log/<id>`
(changelog batches that no run holds yet), `wal/<id>` (single writes that no batch holds yet, a line each with a checksum) and
`manifest/<version>.json`, of which the highest version is the state. A version is complete when it appears and never
replaced: the first of two writers wins and the second fails. Files that no version names are leftovers of a crash; they
have no effect. There is one writer at a time.

Every put and delete is in the write-ahead log before it returns; opening a store replays the log up to the first damaged
line. Writes gather in a buffer; a buffer that is full is frozen, and FROZEN frozen ones are logged as a batch.

Rows carry `seq`; writes take fresh ones. A change log written with `write_log` keeps its own, so its rows may come late or
twice. A delete is only dropped where no older version of its key can be left: in a merge that no other run of the range lies
below, and in a store that takes late changes only up to the watermark (`advance`). No row at or below the newest dropped
delete is accepted afterwards.

Runs and batches that a version no longer names are kept for readers that still use them, until `vacuum` finds them to have
been out of use for long enough.
"""

from __future__ import annotations

import atexit
import json
import shutil
import sys
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.keys import CHANGELOG, DELETE, PUT, VALUE
from ..operators import policy, read
from ..operators.merge import is_put, latest_wins, live
from . import log

#: Frozen buffers that are held before they are logged together, and for how long files out of use are kept.
FROZEN, KEEP_S = 3, 3600.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(sys, "_tidemark_store_dir", None)
        if not found:
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = sys._tidemark_store_dir = "file://" + folder
    return found.rstrip("/")


@dataclass(frozen=True)
class State:
    """What a manifest version says. logs: folder names; runs: dictionaries of id, name, level, first, last (hex keys),
    entries, size and created (seconds). retired: [path, when] of what went out of use. late: whether changes came with a seq
    of their own; low: no later one will be at or below it, as far as the writer says; floor: the newest dropped delete."""

    version: int = 0
    next_id: int = 1
    next_seq: int = 1
    logs: list[str] = field(default_factory=list)
    runs: list[dict] = field(default_factory=list)
    retired: list[list] = field(default_factory=list)
    late: bool = False
    low: int = 0
    floor: int = 0


class KVStore:
    """open / put / delete / get / scan / flush / compact / close."""

    def __init__(self, spark: SparkSession, path: str, state: State, max_buffer: int, durable: bool, clock: Callable[[], float]):
        self.spark, self.path, self.state, self.max_buffer = spark, path.rstrip("/"), state, max_buffer
        self.durable, self.clock = durable, clock
        self.buffer: list[tuple] = []
        self.frozen: list[list[tuple]] = []
        self.buffered = 0
        self.wal = None  # (path, open stream)
        self.next_seq = state.next_seq
        self.closed = False

    # ------------------------------------------------------------ opening and publishing

    @classmethod
    def open(cls, spark: SparkSession, path: str, max_buffer: int = 128 << 20, durable: bool = True, clock: Callable[[], float] = time.time) -> KVStore:
        """Open a folder, or begin one. The state is the newest manifest; single writes that a crash left in the
        write-ahead log are replayed. Without `durable` single writes are safe only once they are synced."""
        store = cls(spark, path, State(), max_buffer, durable, clock)
        versions = store._versions()
        if versions:
            store.state = State(**json.loads(store._read(f"{store.path}/manifest/{max(versions):020d}.json")))
            store.next_seq = store.state.next_seq
        store._recover()
        return store

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, part: str) -> list:
        fs, p = self._fs(f"{self.path}/{part}")
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list("manifest")]
        return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def _name(self) -> str:
        return f"{self.state.next_id:010d}-{uuid.uuid4().hex[:12]}"

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, state: State) -> None:
        """Write the state as the next version and take it over: a temporary file that appears under its name at once, or
        not at all if that version exists. On a local disk this is a hard link, elsewhere a rename that doesn't replace."""
        state = replace(state, version=self.state.version + 1, next_seq=max(self.next_seq, state.next_seq))
        fs, temporary = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/manifest/{state.version:020d}.json")
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(temporary))
            else:
                kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                none = self.spark.sparkContext._gateway.new_array(kind, 1)
                none[0] = kind.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, target, none)
        except Exception as error:
            if fs.exists(target):
                raise RuntimeError(f"another writer has published version {state.version}") from error
            raise
        finally:
            fs.delete(temporary, False)
        self.state, self.next_seq = state, state.next_seq

    def _drop(self, paths: Iterable[str]) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _retired(self, paths: Iterable[str]) -> list[list]:
        now = self.clock()
        return self.state.retired + [[p, now] for p in paths]

    # ------------------------------------------------------------ the write-ahead log

    def _append(self, row: tuple) -> None:
        """One line: checksum, then seq, operation, key and tagged value in hex."""
        if not self.durable:
            return
        if self.wal is None:
            fs, p = self._fs(f"{self.path}/wal/{self._name()}")
            raw = fs.getRaw() if fs.getScheme() == "file" else fs  # a checksummed local file can't be flushed line by line
            raw.mkdirs(p.getParent())
            self.wal = (p.toString(), raw.create(p, False))
        key, seq, op, value = row
        body = f"{seq} {op} {bytes(key).hex()} {codec.tagged(value).hex() if value else ''}"
        self.wal[1].write(bytearray(f"{zlib.crc32(body.encode())} {body}\n".encode()))
        self.wal[1].hflush()

    def _retire_wal(self) -> None:
        if self.wal is not None:
            path, stream = self.wal
            self.wal = None
            stream.close()
            self._drop([path])

    def _recover(self) -> None:
        """Replay what a crashed writer left: of each log the lines before the first damaged one, newest of each key."""
        names = sorted(s.getPath().getName() for s in self._list("wal") if not s.getPath().getName().startswith("."))
        if not names:
            return
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^0*([0-9]+)-", 1).cast("long")
        lines = reduce(DataFrame.unionByName, [self.spark.read.text(f"{self.path}/wal/{n}", wholetext=True).select(number.alias("memtable_id"), F.posexplode(F.split("value", "\n")).alias("pos", "line")) for n in names])
        body = F.substring_index("line", " ", -4)
        lines = lines.where("line <> ''").withColumn("parts", F.split(body, " "))
        good = F.col("line") == F.concat(F.crc32(body.cast("binary")).cast("string"), F.lit(" "), body)
        part = lambda k: F.get("parts", F.lit(k))
        entries = lines.select("memtable_id", "pos", F.coalesce(good, F.lit(False)).alias("good"), part(0).try_cast("long").alias("_seq"), part(1).alias("op"), F.try_to_binary(part(2), F.lit("hex")).alias("key"), F.try_to_binary(part(3), F.lit("hex")).alias("value"))
        rows = log.intact(entries, F.col("good")).select("key", F.col("_seq").alias("seq"), "op", F.when(F.col("op") == PUT, codec.decode(F.col("value"))).cast(VALUE).alias("value"))
        rows = latest_wins(rows).cache()
        try:
            if top := rows.agg(F.max("seq")).first()[0]:
                self.next_seq = max(self.next_seq, top + 1)
                self._log(rows)
        finally:
            rows.unpersist()
        self._drop(f"{self.path}/wal/{n}" for n in names)

    # ------------------------------------------------------------ writing

    def put(self, key: bytes, value, kind: str | None = None) -> None:
        """Upsert one pair. It is durable when this returns."""
        self._one(key, PUT, _value(value, kind))

    def delete(self, key: bytes) -> None:
        """Delete one key, whether or not there is such a key."""
        self._one(key, DELETE, None)

    def _one(self, key: bytes, op: str, value) -> None:
        self._check()
        row = (bytearray(key), self.next_seq, op, value)
        self._append(row)
        self.buffer.append(row)
        self.next_seq += 1
        self.buffered += len(key) + (len(value[1] or "") + len(value[2] or b"") + 8 if value else 0)
        if self.buffered >= self.max_buffer:
            self.freeze()

    def freeze(self) -> None:
        """Set the buffer aside and begin a new one; FROZEN of them are logged as a batch."""
        if self.buffer:
            self.frozen.append(self.buffer)
            self.buffer, self.buffered = [], 0
        if len(self.frozen) >= FROZEN:
            self.sync()

    def sync(self) -> None:
        """Log buffered writes as a batch. If that fails they stay buffered, and in the write-ahead log."""
        self._check()
        rows = [r for part in (*self.frozen, self.buffer) for r in part]
        if rows:
            self._log(self.spark.createDataFrame(rows, CHANGELOG))
            self.frozen, self.buffer, self.buffered = [], [], 0
        self._retire_wal()

    def put_df(self, rows: DataFrame, order: str | None = None) -> None:
        """Upsert a table (key, value). Of rows with equal keys the one with the greatest `order` is newest; without it
        keys must not repeat."""
        self._batch(rows.select("key", F.lit(PUT).alias("op"), "value", *([F.col(order).alias("_order")] if order else [])))

    def delete_df(self, rows: DataFrame) -> None:
        """Delete all keys of a table."""
        self._batch(rows.select("key").distinct().select("key", F.lit(DELETE).alias("op"), F.lit(None).cast(VALUE).alias("value")))

    def write_log(self, rows: DataFrame, late: str = "raise") -> None:
        """Append a changelog (key, seq, op, value) that keeps its own seq, so changes may come late or twice. Only the
        newest row of each key is logged. A row at or below the newest dropped delete, or the watermark, can't be merged
        any more: it is an error, or with late="drop" left out."""
        if late not in ("raise", "drop"):
            raise ValueError("late is 'raise' or 'drop'")
        self.sync()
        least = max(self.state.floor, self.state.low)
        rows = rows.select("key", F.col("seq").cast("bigint").alias("seq"), "op", F.col("value").cast(VALUE).alias("value"))
        if late == "drop":
            rows = rows.where(F.col("seq") > least)
        name = self._name()
        path = f"{self.path}/log/{name}"
        latest_wins(rows).write.parquet(path)
        ends = self.spark.read.schema(CHANGELOG).parquet(path).agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        if ends.a is None or ends.a <= least:
            self._drop([path])
            if ends.a is None:
                return
            raise ValueError(f"a change of seq {ends.a} comes after deletes up to {least} may have been dropped")
        s = self.state
        self._publish(replace(s, next_id=s.next_id + 1, logs=[*s.logs, name], late=True, next_seq=max(self.next_seq, ends.b + 1)))

    def advance(self, seq: int) -> None:
        """Promise that no change at or below seq will come any more; merges may then drop deletes up to it."""
        self._check()
        if seq > self.state.low:
            self._publish(replace(self.state, low=seq))

    def _batch(self, rows: DataFrame) -> None:
        self.sync()
        start = self.next_seq
        if "_order" in rows.columns:  # one newest row a key is enough, and any seq above the older ones will do
            best = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "_order").alias("x"))
            rows = best.select("key", F.col("x.op").alias("op"), F.col("x.value").alias("value"))
        self.next_seq += 1
        self._log(rows.select("key", F.lit(start).cast("bigint").alias("seq"), "op", F.col("value").cast(VALUE).alias("value")))

    def _log(self, rows: DataFrame) -> None:
        name = self._name()
        rows.write.parquet(f"{self.path}/log/{name}")
        self._publish(replace(self.state, next_id=self.state.next_id + 1, logs=[*self.state.logs, name]))

    # ------------------------------------------------------------ reading

    def _frames(self, runs: list[dict], logs: list[str]) -> list[DataFrame]:
        paths = [f"{self.path}/runs/{r['name']}" for r in runs] + [f"{self.path}/log/{n}" for n in logs]
        out = [self.spark.read.schema(CHANGELOG).parquet(*paths)] if paths else []
        if rows := [r for part in (*self.frozen, self.buffer) for r in part]:
            out.append(self.spark.createDataFrame(rows, CHANGELOG))
        return out or [self.spark.createDataFrame([], CHANGELOG)]

    def changelog(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions, of the runs whose key range meets [low, high]."""
        self._check()
        runs = [r for r in self.state.runs if (high is None or bytes.fromhex(r["first"]) <= high) and (low is None or bytes.fromhex(r["last"]) >= low)]
        return reduce(DataFrame.unionByName, self._frames(runs, self.state.logs))

    def get_df(self, key: bytes) -> DataFrame:
        return read.get(self.changelog(key, key), key)

    def get(self, key: bytes):
        """The value of a key, or None. A job a call: look many keys up with multi_get."""
        found = self.get_df(key).select("value").head()
        return None if found is None else plain(found.value)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """The live rows of a table of keys; runs and row groups outside the keys' range aren't read."""
        ends = keys.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
        if ends.a is None:
            return live(self.changelog().limit(0))
        low, high = bytes(ends.a), bytes(ends.b)
        return read.multi_get(self.changelog(low, high).where(F.col("key").between(F.lit(low), F.lit(high))), keys)

    def scan(self, start: bytes, end: bytes) -> DataFrame:
        """Live rows from start to end, both included, in key order."""
        return read.scan(self.changelog(start, end), start, end)

    def live(self) -> DataFrame:
        return live(self.changelog())

    # ------------------------------------------------------------ maintenance

    def _write_run(self, rows: DataFrame, level: int, number: int, created: float) -> dict | None:
        name = self._name()
        path = f"{self.path}/runs/{name}"
        ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
        ordered.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.01").option("maxRecordsPerFile", 20_000_000).parquet(path)
        sums = self.spark.read.schema(CHANGELOG).parquet(path).agg(F.hex(F.min("key")).alias("first"), F.hex(F.max("key")).alias("last"), F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(policy.entry_size()), F.lit(0)).alias("size")).first()
        if not sums.entries:
            self._drop([path])
            return None
        return {"id": number, "name": name, "level": level, "first": sums["first"], "last": sums["last"], "entries": sums.entries, "size": int(sums["size"]), "created": created}

    def flush(self) -> None:
        """Turn what is logged into one run of level 0."""
        self.sync()
        s = self.state
        if not s.logs:
            return
        paths = [f"{self.path}/log/{n}" for n in s.logs]
        run = self._write_run(latest_wins(self.spark.read.schema(CHANGELOG).parquet(*paths)), 0, s.next_id, self.clock())
        self._publish(replace(s, next_id=s.next_id + 1, logs=[], runs=([run] if run else []) + s.runs, retired=self._retired(paths)))

    def metadata(self) -> DataFrame:
        """(level, file_id, first_key, last_key, entries, size, created_at) of the runs."""
        rows = [(r["level"], r["id"], bytearray.fromhex(r["first"]), bytearray.fromhex(r["last"]), r["entries"], r["size"], r["created"]) for r in self.state.runs]
        made = self.spark.createDataFrame(rows, "level int, file_id bigint, first_key binary, last_key binary, entries bigint, size bigint, created double")
        return made.select("level", "file_id", "first_key", "last_key", "entries", "size", F.timestamp_seconds("created").alias("created_at"))

    def compact(self, options: policy.Leveled | policy.Tiered | None = None, cold: policy.Leveled | None = None) -> str | None:
        """One step of compaction, if any is due: its name, or None. Leveled options merge a level into the next
        ("Level"); tiered ones promote, evict or merge hot runs, or merge cold levels by the options `cold`."""
        options = options or policy.Leveled()
        self._check()
        if not self.state.runs:
            return None
        files = self.metadata()
        if isinstance(options, policy.Tiered):
            picked = policy.pick_tiered(files, options, cold or policy.Leveled(), F.timestamp_seconds(F.lit(self.clock()))).collect()
            if not picked:
                return None
            action, chosen = picked[0].action, {r.file_id for r in picked}
            runs = [r for r in self.state.runs if r["id"] in chosen]
            if action == "Promote":
                self._change([], [{**r, "level": 1} if r["id"] in chosen else r for r in self.state.runs])
            elif action.startswith("ColdEvict"):
                self._change(runs, [r for r in self.state.runs if r["id"] not in chosen])
            elif action == "HotMerge":
                self._merge(runs, 0)
            else:
                level = runs[0]["level"]
                task = policy.lower_task(files.where("level >= 1"), level)
                self._merge_chosen(task, level + 1)
            return action
        due = policy.pick_level(files, options).head()
        if due is None:
            return None
        self._merge_chosen(policy.level0_task(files) if due.level == 0 else policy.lower_task(files, due.level), due.level + 1)
        return "Level"

    def _merge_chosen(self, task: DataFrame, level: int) -> None:
        chosen = {r.file_id for r in task.collect()}
        self._merge([r for r in self.state.runs if r["id"] in chosen], level)

    def compact_all(self) -> None:
        """Merge everything into one run at the bottom."""
        self.flush()
        if self.state.runs:
            self._merge(self.state.runs, max(1, max(r["level"] for r in self.state.runs)))

    def _droppable(self, inputs: list[dict], level: int) -> int | None:
        """Up to which seq a merge into a level may drop deletes: None for none of them."""
        s, mine = self.state, {r["id"] for r in inputs}
        low, high = min(r["first"] for r in inputs), max(r["last"] for r in inputs)
        top = min(r["level"] for r in inputs)
        others = [r for r in s.runs if r["id"] not in mine and r["first"] <= high and r["last"] >= low]
        if s.late:  # any other run, and what is logged, may hold older versions
            return None if others or s.logs or not s.low else s.low
        older = [r for r in others if r["level"] >= top and not (r["level"] == 0 and r["id"] > max(mine))]
        return None if level == 0 or older else self.next_seq

    def _merge(self, inputs: list[dict], level: int) -> None:
        """One run for several. A merge of hot runs stays the oldest of them, so it takes the least of their ids."""
        rows = latest_wins(self.spark.read.schema(CHANGELOG).parquet(*[f"{self.path}/runs/{r['name']}" for r in inputs]))
        limit, floor = self._droppable(inputs, level), self.state.floor
        if limit is not None:
            gone = ~is_put() & (F.col("seq") <= limit)
            floor = max(floor, rows.where(gone).agg(F.max("seq")).first()[0] or 0)
            rows = rows.where(~gone)
        number = min(r["id"] for r in inputs) if level == 0 else self.state.next_id
        run = self._write_run(rows, level, number, max(r["created"] for r in inputs))
        gone_ids = {r["id"] for r in inputs}
        self._change(inputs, [r for r in self.state.runs if r["id"] not in gone_ids] + ([run] if run else []), floor)

    def _change(self, gone: list[dict], runs: list[dict], floor: int | None = None) -> None:
        runs = sorted(runs, key=lambda r: (r["level"], -r["id"] if r["level"] == 0 else 0, r["first"]))
        retired = self._retired(f"{self.path}/runs/{r['name']}" for r in gone)
        self._publish(replace(self.state, next_id=self.state.next_id + 1, runs=runs, retired=retired, floor=self.state.floor if floor is None else floor))

    def vacuum(self, older_than_s: float = KEEP_S) -> None:
        """Remove runs and batches that went out of use so long ago that no reader can need them, leftovers of crashes as
        old, and all manifests but the newest."""
        self._check()
        s, before = self.state, self.clock() - older_than_s
        old = [p for p, when in s.retired if when <= before]
        if old:
            self._publish(replace(s, retired=[x for x in s.retired if x[0] not in set(old)]))
            self._drop(old)
        known = {"runs": {r["name"] for r in s.runs}, "log": set(s.logs)}
        kept = {p.rsplit("/", 1)[1] for p, _ in self.state.retired}
        for part, names in known.items():
            stale = [x for x in self._list(part) if x.getPath().getName() not in names | kept and x.getModificationTime() / 1000 <= time.time() - older_than_s]
            self._drop(f"{self.path}/{part}/{x.getPath().getName()}" for x in stale)
        self._drop(f"{self.path}/manifest/{v:020d}.json" for v in self._versions() if v < self.state.version)

    def close(self) -> None:
        """Flush everything; the store can't be used after."""
        if not self.closed:
            self.flush()
            self.closed = True

    def _check(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _value(value, kind: str | None) -> tuple:
    """A value row for a Python value; kind is needed to tell u64 from i64."""
    from decimal import Decimal

    if kind is None:
        kind = {str: "String", bytes: "Bytes", bytearray: "Bytes", float: "f64", bool: "bool", int: "i64"}[type(value)]
    made = {"String": str, "Bytes": bytearray, "f64": float, "i64": int, "u64": Decimal, "bool": bool}[kind](value)
    return (kind, *[made if k == kind else None for k in ("String", "Bytes", "f64", "i64", "u64", "bool")])


def plain(value):
    """The Python value of a value row."""
    from ..functions.keys import FIELD_OF

    got = value[FIELD_OF[value.kind]]
    return bytes(got) if value.kind == "Bytes" else int(got) if value.kind == "u64" else got


__all__ = ["KVStore", "State", "plain"]
