"""The catalogue of key-value queries over the driver's tables, each with its SQL.

The op log is `events`: key = user_id as eight bytes, seq = event_id, an event of type 'error' is a delete, any other a
put of `value`. Keys are shown as hex, in the bytes' order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..functions.keys import DELETE, PUT, int_key, run_file_name, value_of
from ..operators import merge, policy
from ..operators.segment import segments
from ..sources import log, manifest
from ..streaming.ingest import latest_stream

#: Parameters of the queries: keys, file policies and segment sizes, chosen so that each has work at every scale.
GET, DELETED, LOW, HIGH = 7, 5, 4, 60
LEVELED = policy.Leveled(multiplier=2, max_levels=3, level0_threshold=2, base_bytes=40_000)
TIERED = policy.Tiered(hot_ttl_s=200_000, max_hot=4, small_bytes=1 << 40, max_output_bytes=1 << 42, cold_max_bytes=150_000, cold_ttl_s=500_000)
#: Options under which only cold compaction is left to do.
COLD = policy.Tiered(hot_ttl_s=1 << 40, max_hot=1 << 30, small_bytes=1, max_output_bytes=1, cold_max_bytes=1 << 60)
FREEZE_BYTES, BLOCK_BYTES = 2_000, 400
#: Strange keys that a Bloom filter of fewer keys is probed with.
OTHERS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str, users=None) -> DataFrame:
    """(key, seq, op, value) with a plain double as value: columns of fixed width, so the merge hashes.

    users: a predicate on user_id. The key keeps its order, so a range of keys is a range of ids, which Parquet can use."""
    e = table(spark, sf_dir, "events")
    e = e if users is None else e.where(users)
    return e.select(int_key(F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("gone"), "value")


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.hex("key").alias("key"), "seq", "value")


def newest(rows: DataFrame) -> DataFrame:
    return merge.latest_wins(rows).where("NOT gone")


LOG = "log AS (SELECT printf('%016X', user_id) AS key, event_id AS seq, event_type = 'error' AS gone, value FROM events)"
LATEST = "latest AS (SELECT key, seq, gone, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"


def kv_latest(spark, sf_dir):
    return shown(newest(oplog(spark, sf_dir)))


def kv_get(spark, sf_dir):
    return shown(newest(oplog(spark, sf_dir, F.col("user_id") == GET)))


def kv_get_deleted(spark, sf_dir):
    """A key right after its newest delete: the log up to there has no live row of it."""
    rows = oplog(spark, sf_dir, F.col("user_id") == DELETED)
    upto = rows.where("gone").agg(F.max("seq").alias("upto"))
    return shown(newest(rows.join(F.broadcast(upto), F.col("seq") <= F.col("upto")).drop("upto")))


def kv_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(int_key(F.col("c_custkey")).alias("key"))
    rows = oplog(spark, sf_dir)
    return shown(newest(rows.join(keys.distinct(), "key", "left_semi")))


def kv_scan_range(spark, sf_dir):
    return shown(newest(oplog(spark, sf_dir, F.col("user_id").between(LOW, HIGH)))).orderBy("key")


def kv_scan_empty(spark, sf_dir):
    return shown(newest(oplog(spark, sf_dir, F.col("user_id").between(HIGH, LOW)))).orderBy("key")


def bounds(spark, sf_dir) -> tuple[int, int]:
    """The least and greatest seq: one row, from the files' statistics."""
    r = table(spark, sf_dir, "events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    return (r.a or 0), (r.b or 0)


def tiers(spark, sf_dir) -> list[DataFrame]:
    """The log cut into four runs by seq, newest first, each with one row a key."""
    a, b = bounds(spark, sf_dir)
    rows = oplog(spark, sf_dir)
    return [merge.latest_wins(rows.where(F.col("seq").between(*quarter(a, b, q)))) for q in (3, 2, 1, 0)]


def quarter(a: int, b: int, q: int) -> tuple[int, int]:
    """The first and last seq of a quarter of a..b, as bounds that Parquet can use."""
    n = b - a + 1
    return a - (-q * n // 4), a - (-(q + 1) * n // 4) - 1


TIER = f"{LOG}, edge AS (SELECT min(seq) AS a, max(seq) AS b FROM log), tier AS (SELECT log.*, 3 - CAST(floor((seq - a) * 4 / (b - a + 1)) AS INT) AS t FROM log, edge)"
RUNS = f"{TIER}, runs AS (SELECT key, seq, gone, value, t FROM (SELECT *, row_number() OVER (PARTITION BY t, key ORDER BY seq DESC) AS rn FROM tier) WHERE rn = 1)"


def merge_k_runs(spark, sf_dir):
    return shown(merge.merge_runs(tiers(spark, sf_dir)).where("NOT gone"))


def merge_two_way(spark, sf_dir):
    """The two newest runs, deletes included."""
    got = merge.two_way_merge(*tiers(spark, sf_dir)[:2])
    return got.select(F.hex("key").alias("key"), "seq", "gone", "value")


def compact_keep_tombstones(spark, sf_dir):
    runs = tiers(spark, sf_dir)[:2]
    got = merge.latest_wins(runs[0].unionByName(runs[1]))
    return got.select(F.hex("key").alias("key"), "seq", "gone", "value")


def compact_bottom(spark, sf_dir):
    runs = tiers(spark, sf_dir)
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return shown(merge.latest_wins(every).where("NOT gone"))


def compaction_invariant(spark, sf_dir):
    """Live rows with and without compacting the two newest runs: what differs, which must be nothing."""
    a, b, c, d = tiers(spark, sf_dir)
    compacted = merge.latest_wins(a.unionByName(b))
    one = newest(compacted.unionByName(c).unionByName(d)).select("key", "seq", "value")
    two = newest(oplog(spark, sf_dir)).select("key", "seq", "value")
    return shown(one.exceptAll(two).unionByName(two.exceptAll(one)))


# ---------------------------------------------------------------- file metadata


def file_rows(spark, sf_dir) -> DataFrame:
    """Rows of files: the newest quarter of the log in hot files by time, the middle ones in files by key on level 1, the
    oldest in fewer files by key on level 2."""
    a, b = bounds(spark, sf_dir)
    step = (b - a + 1) // 24 + 1
    e = table(spark, sf_dir, "events")
    quarter = F.floor((F.col("event_id") - a) * 4 / (b - a + 1))
    level = F.when(quarter == 3, 0).when(quarter == 0, 2).otherwise(1)
    file_id = F.when(level == 0, 1000 + F.floor((F.col("event_id") - a) / step)).when(level == 1, 2000 + F.floor(F.col("user_id") / 10)).otherwise(3000 + F.floor(F.col("user_id") / 25))
    return e.select(level.alias("level"), file_id.cast("bigint").alias("file_id"), int_key(F.col("user_id")).alias("key"), (F.length("props") + 21).cast("bigint").alias("size"), F.col("ts").cast("timestamp").alias("created_at"))


def files(spark, sf_dir) -> DataFrame:
    return policy.run_metadata(file_rows(spark, sf_dir))


def now(spark, sf_dir):
    """A fixed now: a second after the newest event."""
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("t")).first().t
    return F.lit(last) + F.expr("INTERVAL 1 SECOND")


FILES = """edge AS (SELECT min(event_id) AS a, max(event_id) AS b FROM events),
placed AS (SELECT events.*, a, b, (b - a + 1) // 24 + 1 AS step, floor((event_id - a) * 4 / (b - a + 1)) AS q FROM events, edge),
levelled AS (SELECT *, CASE q WHEN 3 THEN 0 WHEN 0 THEN 2 ELSE 1 END AS level FROM placed),
rows_ AS (SELECT level, CASE level WHEN 0 THEN 1000 + (event_id - a) // step WHEN 1 THEN 2000 + user_id // 10 ELSE 3000 + user_id // 25 END AS file_id,
  printf('%016X', user_id) AS key, length(props) + 21 AS size, ts FROM levelled),
files AS (SELECT level, file_id, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, CAST(sum(size) AS BIGINT) AS size, max(ts) AS created_at FROM rows_ GROUP BY level, file_id),
aged AS (SELECT *, epoch((SELECT max(ts) FROM events)) + 1 - epoch(created_at) AS age FROM files)"""


def run_metadata(spark, sf_dir):
    m = files(spark, sf_dir)
    return m.select("level", "file_id", F.hex("first_key").alias("first_key"), F.hex("last_key").alias("last_key"), "entries", "size")


def concat_validate(spark, sf_dir):
    return merge.bad_neighbours(files(spark, sf_dir))


def overlap_files(spark, sf_dir):
    m = files(spark, sf_dir)
    return policy.overlap_pairs(m.where("level = 1"), m.where("level = 2"))


def compact_l0_task(spark, sf_dir):
    return policy.level0_task(files(spark, sf_dir))


def compact_lower_task(spark, sf_dir):
    return policy.lower_task(files(spark, sf_dir), 1)


def level_scores(spark, sf_dir):
    return policy.level_scores(files(spark, sf_dir), LEVELED)


def level_pick(spark, sf_dir):
    return policy.pick_level(files(spark, sf_dir), LEVELED).select("level", "files", "bytes")


def fifo_promote_prefix(spark, sf_dir):
    return policy.expired_prefix(files(spark, sf_dir), TIERED, now(spark, sf_dir))


def fifo_cold_ttl(spark, sf_dir):
    return policy.expired_cold(files(spark, sf_dir), TIERED, now(spark, sf_dir))


def fifo_size_cap(spark, sf_dir):
    return policy.over_cap(files(spark, sf_dir), TIERED)


def fifo_hot_merge(spark, sf_dir):
    return policy.small_run(files(spark, sf_dir), TIERED)


def fifo_pick(spark, sf_dir):
    return policy.pick_tiered(files(spark, sf_dir), TIERED, LEVELED, now(spark, sf_dir))


def compaction_apply(spark, sf_dir):
    """Metadata after merging all of level 0 and the overlapping files of level 1 into file 9000 of level 1."""
    m = files(spark, sf_dir)
    gone = policy.level0_task(m)
    # Files of different levels may share a number, so a file is one by level and number; what goes goes by number.
    merged = gone.select(F.when(F.col("side") == "input", 0).otherwise(1).alias("level"), "file_id")
    inputs = m.join(merged, ["level", "file_id"], "left_semi")
    made = inputs.agg(F.lit(1).alias("level"), F.lit(9000).cast("bigint").alias("file_id"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("entries").alias("entries"), F.sum("size").alias("size"), F.max("created_at").alias("created_at"))
    after = policy.applied(m, gone, made.where("entries IS NOT NULL"))
    return after.select("level", "file_id", F.hex("first_key").alias("first_key"), F.hex("last_key").alias("last_key"), "entries", "size")


def bloom_params(spark, sf_dir):
    m = files(spark, sf_dir)
    return m.select("file_id", "entries", bloom.parameters(F.col("entries")).alias("p")).select("file_id", "entries", "p.bits", "p.bytes", "p.bits_per_key", "p.probes")


def fifo_pick_cold(spark, sf_dir):
    """What is picked when neither age nor sizes of files call for anything: a cold compaction."""
    return policy.pick_tiered(files(spark, sf_dir), COLD, LEVELED, now(spark, sf_dir))


def bloom_probe(spark, sf_dir):
    """A filter a file, as stored words, probed with the file's own keys, of which it must miss none, and with as many
    others but OTHERS at least, of which at most 1 in 20 may pass (1 in 100 is what the size is for). With fewer others
    chance would judge: of 35, one filter in some thousands of the right size passes 4."""
    keys = file_rows(spark, sf_dir).select("file_id", "key").distinct()
    sized = keys.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_keys"), bloom.parameters(F.count(F.lit(1))).alias("p")).select("file_id", "n_keys", bloom.stored_bits(F.col("p.bits")).alias("bits"))
    known = keys.join(sized, "file_id")
    at = lambda rows: rows.select("file_id", "key", F.explode(bloom.probes(F.col("key"), F.col("bits"), 6)).alias("bit"))
    words = at(known).groupBy("file_id", bloom.word_of(F.col("bit")).alias("word")).agg(F.bit_or(bloom.bit_in_word(F.col("bit"))).alias("bits"))

    def passing(rows: DataFrame, name: str) -> DataFrame:
        probed = at(rows).withColumn("word", bloom.word_of(F.col("bit"))).join(words, ["file_id", "word"], "left")
        each = probed.groupBy("file_id", "key").agg(F.min(bloom.is_set(F.col("bits"), F.col("bit")).cast("int")).alias("all"))
        return each.groupBy("file_id").agg(F.sum("all").alias(name))

    # A filter of few keys fits in a row, which its strange keys are made and tried beside; others take a row a probe.
    strange = known.where(F.col("n_keys") >= OTHERS).withColumn("key", F.concat(F.lit(b"not "), "key"))
    small = sized.where(F.col("n_keys") < OTHERS).select("file_id", F.col("bits").alias("size"))
    whole = words.join(small, "file_id").groupBy("file_id", "size").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    # Few bytes with much to do each: dealt by a number of tasks, which isn't lowered by their bytes.
    whole = whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id", "size")
    tried = whole.select("file_id", "words", F.col("size").alias("bits"), F.explode(F.sequence(F.lit(1), F.lit(OTHERS))).alias("i"))
    tried = tried.select("file_id", "words", "bits", F.concat(F.lit(b"not "), int_key(F.col("file_id")), int_key(F.col("i"))).alias("key"))
    passed = tried.groupBy("file_id").agg(F.sum(bloom.may_contain(F.col("words"), F.col("key"), F.col("bits"), 6).cast("int")).alias("other"))

    met = sized.join(passing(known, "own"), "file_id").join(passing(strange, "other").unionByName(passed), "file_id")
    return met.select("file_id", "n_keys", (F.col("n_keys") - F.col("own")).alias("n_missed"), (F.col("other") * 20 <= F.greatest("n_keys", F.lit(OTHERS))).alias("few_others"))


def run_names(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", run_file_name(F.col("file_id")).alias("name"))


# ---------------------------------------------------------------- a store on disk


def change_log(rows: DataFrame) -> DataFrame:
    """The op log with the store's own values."""
    return rows.select("key", "seq", F.when(F.col("gone"), DELETE).otherwise(PUT).alias("op"), F.when(~F.col("gone"), value_of("f64", F.col("value"))).alias("value"))


def stored(spark, sf_dir, quarters=(0, 1, 2, 3), clock=None):
    """A new store with a run of level 0 for each quarter of the op log, oldest first."""
    import uuid

    from ..sources.store import KVStore, shared_dir

    a, b = bounds(spark, sf_dir)
    clock = clock or Clock()
    store = KVStore.open(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", clock=clock)
    rows = change_log(oplog(spark, sf_dir))
    for q in quarters:
        clock.now += 100
        part = rows.where(F.col("seq").between(*quarter(a, b, q)))
        store.write_log(part)
        store.flush()
    return store


class Clock:
    """A clock that is set by hand."""

    def __init__(self):
        self.now = 0.0

    def __call__(self) -> float:
        return self.now


def values(rows: DataFrame) -> DataFrame:
    return rows.select(F.hex("key").alias("key"), "seq", F.col("value.f").alias("value"))


def store_scan(spark, sf_dir):
    """A range of a store of four runs."""
    low, high = (k.to_bytes(8, "big") for k in (LOW, HIGH))
    return values(stored(spark, sf_dir).scan(low, high))


def store_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(int_key(F.col("c_custkey")).alias("key"))
    return values(stored(spark, sf_dir).multi_get(keys))


def store_compacted(spark, sf_dir):
    """Leveled steps till none is due, then all in one run, with old versions and old deletes gone."""
    store = stored(spark, sf_dir)
    while store.compact(policy.Leveled(base_bytes=1, max_levels=3)):
        pass
    store.advance(bounds(spark, sf_dir)[1])
    store.compact_all()
    store.vacuum(0)
    assert len(store.state.runs) <= 1
    rows = store.changelog()
    return rows.select(F.hex("key").alias("key"), "seq", "op", F.col("value.f").alias("value"))


def store_reopened(spark, sf_dir):
    """A store whose writer stopped without closing: two quarters flushed, one logged, three single writes in the
    write-ahead log only; opened again."""
    from ..sources.store import KVStore

    store = stored(spark, sf_dir, (0, 1))
    a, b = bounds(spark, sf_dir)
    store.write_log(change_log(oplog(spark, sf_dir)).where(F.col("seq").between(quarter(a, b, 2)[0], b)))
    store.put(b"\xff", 1.5)
    store.put(b"\xff\xff", 2.5)
    store.delete(b"\xff")
    return values(KVStore.open(spark, store.path).live()).select("key", "value")


def run_rows(store, action: str | None) -> DataFrame:
    return store.metadata().select(F.lit(action).alias("action"), "level", "entries")


def store_promoted(spark, sf_dir):
    """The runs after those past the TTL, the two oldest, have been promoted."""
    clock = Clock()
    store = stored(spark, sf_dir, clock=clock)
    times = sorted(r["created"] for r in store.state.runs)
    clock.now = times[1] + 10
    return run_rows(store, store.compact(policy.Tiered(hot_ttl_s=10, max_hot=100, small_bytes=1, max_output_bytes=1, cold_max_bytes=1 << 60)))


def store_hot_merged(spark, sf_dir):
    """The runs after the three oldest of four small hot ones have been merged into one."""
    store = stored(spark, sf_dir, clock=Clock())
    oldest = sum(sorted((r["id"], r["size"]) for r in store.state.runs)[k][1] for k in range(3))
    return run_rows(store, store.compact(policy.Tiered(hot_ttl_s=1 << 40, max_hot=3, small_bytes=1 << 50, max_output_bytes=oldest, cold_max_bytes=1 << 60)))


def store_cold_evicted(spark, sf_dir):
    """What is live after the two oldest runs have been promoted and evicted by age."""
    clock = Clock()
    store = stored(spark, sf_dir, clock=clock)
    times = sorted(r["created"] for r in store.state.runs)
    clock.now = times[1] + 10
    options = policy.Tiered(hot_ttl_s=10, max_hot=100, small_bytes=1, max_output_bytes=1, cold_max_bytes=1 << 60, cold_ttl_s=10)
    actions = [store.compact(options), store.compact(options)]
    return values(store.live()).withColumn("actions", F.lit(" ".join(map(str, actions))))


def store_cold_compacted(spark, sf_dir):
    """What is live after all runs have been promoted and merged downwards, with the actions taken."""
    clock = Clock()
    store = stored(spark, sf_dir, clock=clock)
    clock.now += 1000
    actions = [store.compact(policy.Tiered(hot_ttl_s=10, max_hot=100, small_bytes=1, max_output_bytes=1, cold_max_bytes=1 << 60))]
    actions += [store.compact(COLD, policy.Leveled(base_bytes=1, max_levels=3)) for _ in range(2)]
    return values(store.live()).withColumn("actions", F.lit(" ".join(map(str, actions))))


# ---------------------------------------------------------------- manifest and log


def records(spark, sf_dir) -> DataFrame:
    """A manifest made from orders: every order opens a buffer, two of three are flushed, every tenth compacts the four
    files before it into a new one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 10).alias("pos"))
    none = F.lit(None).cast("array<bigint>")
    ids = lambda name: F.lit(None).cast("bigint").alias(name)
    level = lambda c, name: c.cast("int").alias(name)
    opened = o.select("pos", F.lit("NewMemtable").alias("kind"), F.col("k").alias("id"), level(F.lit(None), "next_level"), none.alias("inputs"), none.alias("overlapping"), none.alias("outputs"))
    flushed = o.where("k % 3 <> 0").select((F.col("pos") + 1).alias("pos"), F.lit("Flush").alias("kind"), F.col("k").alias("id"), level(F.lit(None), "next_level"), none.alias("inputs"), none.alias("overlapping"), none.alias("outputs"))
    made = o.where("k % 10 = 0").select(
        (F.col("pos") + 2).alias("pos"),
        F.lit("CompactionResult").alias("kind"),
        ids("id"),
        level(1 + F.col("k") % 3, "next_level"),
        F.array(F.col("k") - 1, F.col("k") - 2).alias("inputs"),
        F.array(F.col("k") - 3, F.col("k") - 4).alias("overlapping"),
        F.array(F.col("k") + 1_000_000_000).alias("outputs"),
    )
    return opened.unionByName(flushed).unionByName(made)


def manifest_live_files(spark, sf_dir):
    return manifest.live_files(records(spark, sf_dir))


def manifest_unflushed(spark, sf_dir):
    return manifest.unflushed(records(spark, sf_dir))


def manifest_next_id(spark, sf_dir):
    return manifest.next_id(records(spark, sf_dir))


def wal_replay_cut(spark, sf_dir):
    """A log for each event_id // 500, in which the entry at 300 of every second log is damaged; the newest intact
    operation of each key."""
    e = table(spark, sf_dir, "events")
    entries = e.select(
        F.floor(F.col("event_id") / 500).alias("memtable_id"),
        (F.col("event_id") % 500).alias("pos"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        int_key(F.col("user_id")).alias("key"),
        F.col("props").cast("binary").alias("value"),
    )
    crc = log.checksum(F.col("op"), F.col("key"), F.col("value"))
    stored = entries.withColumn("crc", F.when((F.col("pos") == 300) & (F.col("memtable_id") % 2 == 1), crc + 1).otherwise(crc))
    got = log.replay(stored, F.col("crc") == crc)
    return got.select(F.hex("key").alias("key"), F.col("seq.memtable_id").alias("memtable_id"), F.col("seq.pos").alias("pos"), "op", F.col("value").cast("string").alias("value"))


# ---------------------------------------------------------------- values


def tagged(spark, sf_dir) -> DataFrame:
    """events with a value of a kind for each event type."""
    e = table(spark, sf_dir, "events")
    value = (
        F.when(F.col("event_type") == "click", value_of("f64", F.col("value")))
        .when(F.col("event_type") == "view", value_of("String", F.col("props")))
        .when(F.col("event_type") == "purchase", value_of("i64", F.col("event_id") - 5000))
        .when(F.col("event_type") == "signup", value_of("bool", F.col("event_id") % 2 == 0))
        .otherwise(value_of("u64", F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("event_id")))
    )
    return e.select("event_id", value.alias("v"))


def value_kinds(spark, sf_dir):
    return tagged(spark, sf_dir).groupBy(F.col("v.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(codec.byte_size(F.col("v"))).alias("bytes"))


def value_bytes(spark, sf_dir):
    """Tagged bytes of all kinds but doubles (DuckDB doesn't show a double's bytes; codec_roundtrip has these). Sign-ups give
    a boolean, and their properties as bytes besides."""
    rows = tagged(spark, sf_dir)
    raw = table(spark, sf_dir, "events").where("event_type = 'signup'").select((-F.col("event_id") - 1).alias("event_id"), value_of("Bytes", F.col("props").cast("binary")).alias("v"))
    rows = rows.where("v.kind <> 'f64'").unionByName(raw)
    return rows.select("event_id", F.hex(codec.encode(F.col("v"))).alias("data"), codec.is_empty(F.lit(PUT), codec.encode(F.col("v"))).alias("empty"))


def codec_roundtrip(spark, sf_dir):
    """Values that differ after encoding and decoding: none. Counts by kind."""
    rows = tagged(spark, sf_dir)
    back = rows.withColumn("w", codec.decode(codec.encode(F.col("v"))))
    return back.groupBy(F.col("v.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("v").eqNullSafe(F.col("w"))).cast("int")).cast("bigint").alias("n_differ"))


# ---------------------------------------------------------------- segments and streams


def freeze_rows(spark, sf_dir) -> DataFrame:
    """Writes of 16 streams (user_id % 16), each a buffer of its own."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 16).alias("stream"), F.col("event_id").alias("seq"), (F.length("props") + 17).cast("bigint").alias("size"))


def memtable_running_size(spark, sf_dir):
    """Bytes written to each buffer up to each write, overwrites counted again."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return freeze_rows(spark, sf_dir).withColumn("total", F.sum("size").over(w)).select("stream", "seq", "total")


def memtable_freeze_segments(spark, sf_dir):
    got = segments(freeze_rows(spark, sf_dir), FREEZE_BYTES)
    return got.groupBy("stream", "segment").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def block_segments(spark, sf_dir):
    got = segments(freeze_rows(spark, sf_dir), BLOCK_BYTES, fits=True)
    return got.groupBy("stream", "segment").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def stream_latest(spark, sf_dir):
    """kv_latest of the log read as a stream, to the end of what there is."""
    import uuid

    from ..sources.store import shared_dir

    name, source = f"latest_{uuid.uuid4().hex}", f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    base = f"{shared_dir(spark)}/{name}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(source)
    store = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    # A stream reads folders; a table that is one file is found by a pattern in its folder.
    rows = spark.readStream.schema(schema).parquet(source) if store.getFileStatus(fs).isDirectory() else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    changes = rows.select(int_key(F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("gone"), "value")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    latest_stream(changes).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.schema("key binary, seq bigint, gone boolean, value double").parquet(f"{base}/out").where("NOT gone"))


SEGMENTS = """w AS (SELECT user_id % 16 AS stream, event_id AS seq, length(props) + 17 AS size, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS k FROM events)"""

COLD_PICK = f"""due AS (SELECT level FROM (SELECT level, CAST(sum(size) AS BIGINT) / ({LEVELED.base_bytes}::DOUBLE * power({LEVELED.multiplier}::DOUBLE, level - 1)) AS score FROM files WHERE level >= 1 GROUP BY level)
  WHERE level < {LEVELED.max_levels} AND score > 1 ORDER BY score DESC, level LIMIT 1),
p5 AS (SELECT file_id FROM files WHERE level = (SELECT level FROM due) ORDER BY first_key, file_id LIMIT 1)"""

SQL: dict[str, str] = {
    "kv_latest": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone",
    "kv_get": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone AND key = printf('%016X', {GET})",
    "kv_get_deleted": f"WITH {LOG}, upto AS (SELECT max(seq) AS s FROM log WHERE gone AND key = printf('%016X', {DELETED})), past AS (SELECT log.* FROM log, upto WHERE seq <= s AND key = printf('%016X', {DELETED})) SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM past) WHERE rn = 1 AND NOT gone",
    "kv_multi_get": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone AND key IN (SELECT printf('%016X', c_custkey) FROM customer WHERE c_custkey % 10 = 0)",
    "kv_scan_range": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone AND key BETWEEN printf('%016X', {LOW}) AND printf('%016X', {HIGH})",
    "kv_scan_empty": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone AND key BETWEEN printf('%016X', {HIGH}) AND printf('%016X', {LOW})",
    "merge_k_runs": f"WITH {RUNS} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq DESC) AS r FROM runs) WHERE r = 1 AND NOT gone",
    "merge_two_way": f"WITH {RUNS}, a AS (SELECT * FROM runs WHERE t = 0), b AS (SELECT * FROM runs WHERE t = 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN a.seq ELSE b.seq END AS seq, CASE WHEN a.key IS NOT NULL THEN a.gone ELSE b.gone END AS gone, CASE WHEN a.key IS NOT NULL THEN a.value ELSE b.value END AS value FROM a FULL JOIN b ON a.key = b.key",
    "compact_keep_tombstones": f"WITH {RUNS} SELECT key, seq, gone, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM runs WHERE t <= 1) WHERE r = 1",
    "compact_bottom": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone",
    "compaction_invariant": f"WITH {LOG} SELECT key, seq, value FROM log WHERE false",
    "run_metadata": f"WITH {FILES} SELECT level, file_id, first_key, last_key, entries, size FROM files",
    "concat_validate": f"WITH {FILES}, c AS (SELECT *, lag(last_key) OVER w AS before, lag(file_id) OVER w AS left_id FROM files WINDOW w AS (PARTITION BY level ORDER BY first_key, file_id)) SELECT level, left_id, file_id AS right_id FROM c WHERE before >= first_key",
    "overlap_files": f"WITH {FILES} SELECT u.file_id AS upper_id, v.file_id AS lower_id FROM files u JOIN files v ON u.level = 1 AND v.level = 2 AND u.first_key <= v.last_key AND u.last_key >= v.first_key",
    "compact_l0_task": f"WITH {FILES}, s AS (SELECT min(first_key) AS lo, max(last_key) AS hi FROM files WHERE level = 0) SELECT 'input' AS side, file_id FROM files WHERE level = 0 UNION ALL SELECT 'overlap', file_id FROM files, s WHERE level = 1 AND first_key <= hi AND last_key >= lo",
    "compact_lower_task": f"WITH {FILES}, f AS (SELECT * FROM files WHERE level = 1 ORDER BY first_key, file_id LIMIT 1) SELECT 'input' AS side, file_id FROM f UNION ALL SELECT 'overlap', files.file_id FROM files, f WHERE files.level = 2 AND files.first_key <= f.last_key AND files.last_key >= f.first_key",
    "level_scores": f"WITH {FILES}, s AS (SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY level) SELECT level, files, bytes, CASE WHEN level = 0 THEN files / {LEVELED.level0_threshold}.0::DOUBLE ELSE bytes / ({LEVELED.base_bytes}::DOUBLE * power({LEVELED.multiplier}::DOUBLE, level - 1)) END AS score FROM s",
    "level_pick": f"WITH {FILES}, s AS (SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY level), t AS (SELECT *, CASE WHEN level = 0 THEN files / {LEVELED.level0_threshold}.0::DOUBLE ELSE bytes / ({LEVELED.base_bytes}::DOUBLE * power({LEVELED.multiplier}::DOUBLE, level - 1)) END AS score FROM s WHERE level < {LEVELED.max_levels}) SELECT level, files, bytes FROM t WHERE score > 1 OR (level = 0 AND score >= 1) ORDER BY level <> 0, score DESC, level LIMIT 1",
    "fifo_promote_prefix": f"WITH {FILES} SELECT file_id FROM (SELECT file_id, min(CASE WHEN age >= {TIERED.hot_ttl_s} THEN 1 ELSE 0 END) OVER (ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS ok FROM aged WHERE level = 0) WHERE ok = 1",
    "fifo_cold_ttl": f"WITH {FILES} SELECT file_id FROM aged WHERE level >= 1 AND age >= {TIERED.cold_ttl_s}",
    "fifo_size_cap": f"WITH {FILES} SELECT file_id FROM (SELECT file_id, sum(size) OVER () - {TIERED.cold_max_bytes} AS excess, coalesce(sum(size) OVER (ORDER BY level DESC, first_key, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM files WHERE level >= 1) WHERE freed < excess",
    "fifo_hot_merge": f"WITH {FILES}, h AS (SELECT file_id, size, sum(size) OVER (ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER () AS n FROM files WHERE level = 0), k AS (SELECT file_id, n, min(CASE WHEN size <= {TIERED.small_bytes} AND s <= {TIERED.max_output_bytes} THEN 1 ELSE 0 END) OVER (ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS ok FROM h) SELECT file_id FROM k WHERE n > {TIERED.max_hot} AND ok = 1 AND (SELECT count(*) FROM k WHERE ok = 1) >= 2",
    "compaction_apply": f"WITH {FILES}, s AS (SELECT min(first_key) AS lo, max(last_key) AS hi FROM files WHERE level = 0), gone AS (SELECT files.* FROM files, s WHERE level = 0 OR (level = 1 AND first_key <= hi AND last_key >= lo)) SELECT level, file_id, first_key, last_key, entries, size FROM files WHERE file_id NOT IN (SELECT file_id FROM gone) UNION ALL SELECT 1, 9000, min(first_key), max(last_key), CAST(sum(entries) AS BIGINT), CAST(sum(size) AS BIGINT) FROM gone HAVING count(*) > 0",
    "bloom_params": f"WITH {FILES}, b AS (SELECT file_id, entries, CAST(floor(-(entries::DOUBLE) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM files) SELECT file_id, entries, bits, CAST(ceil(bits / 8.0) AS BIGINT) AS bytes, 10 AS bits_per_key, 6 AS probes FROM b",
    "bloom_probe": f"WITH {FILES} SELECT file_id, count(DISTINCT key) AS n_keys, CAST(0 AS BIGINT) AS n_missed, true AS few_others FROM rows_ GROUP BY file_id",
    "run_names": f"WITH {FILES} SELECT file_id, printf('sst-%05d.sst', file_id) AS name FROM files",
    "fifo_pick_cold": f"WITH {FILES}, {COLD_PICK} SELECT 'ColdCompact' AS action, file_id FROM p5",
    "store_scan": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone AND key BETWEEN printf('%016X', {LOW}) AND printf('%016X', {HIGH})",
    "store_multi_get": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone AND key IN (SELECT printf('%016X', c_custkey) FROM customer WHERE c_custkey % 10 = 0)",
    "store_compacted": f"WITH {LOG}, {LATEST} SELECT key, seq, 'put' AS op, value FROM latest WHERE NOT gone",
    "store_reopened": f"WITH {LOG}, {LATEST} SELECT key, value FROM latest WHERE NOT gone UNION ALL SELECT 'FFFF', 2.5::DOUBLE",
    "store_promoted": f"WITH {RUNS} SELECT 'Promote' AS action, CASE WHEN t >= 2 THEN 1 ELSE 0 END AS level, count(*) AS entries FROM runs GROUP BY t",
    "store_hot_merged": f"WITH {RUNS} SELECT 'HotMerge' AS action, 0 AS level, count(DISTINCT key) AS entries FROM runs GROUP BY t > 0",
    "store_cold_evicted": f"WITH {TIER}, newer AS (SELECT key, seq, gone, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM tier WHERE t <= 1) WHERE rn = 1) SELECT key, seq, value, 'Promote ColdEvictTtl' AS actions FROM newer WHERE NOT gone",
    "store_cold_compacted": f"WITH {LOG}, {LATEST} SELECT key, seq, value, 'Promote ColdCompact ColdCompact' AS actions FROM latest WHERE NOT gone",
    "manifest_live_files": "WITH o AS (SELECT o_orderkey AS k FROM orders), said AS (SELECT k * 10 + 1 AS pos, k AS file_id, 0 AS level, true AS alive FROM o WHERE k % 3 <> 0 UNION ALL SELECT k * 10 + 2, k - d, NULL, false FROM o, (VALUES (1), (2), (3), (4)) t(d) WHERE k % 10 = 0 UNION ALL SELECT k * 10 + 2, k + 1000000000, CAST(1 + k % 3 AS INT), true FROM o WHERE k % 10 = 0) SELECT file_id, level FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos DESC, alive DESC) AS rn FROM said) WHERE rn = 1 AND alive",
    "manifest_unflushed": "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0",
    "manifest_next_id": "SELECT greatest(max(o_orderkey), coalesce(max(CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1000000000 END), 0)) + 1 AS next_id FROM orders",
    "wal_replay_cut": "WITH e AS (SELECT event_id // 500 AS memtable_id, event_id % 500 AS pos, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, printf('%016X', user_id) AS key, props AS value FROM events), bad AS (SELECT memtable_id, min(pos) AS p FROM e WHERE pos = 300 AND memtable_id % 2 = 1 GROUP BY memtable_id), ok AS (SELECT e.* FROM e LEFT JOIN bad USING (memtable_id) WHERE p IS NULL OR pos < p) SELECT key, memtable_id, pos, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY memtable_id DESC, pos DESC) AS rn FROM ok) WHERE rn = 1",
    "value_kinds": "SELECT CASE event_type WHEN 'click' THEN 'f64' WHEN 'view' THEN 'String' WHEN 'purchase' THEN 'i64' WHEN 'signup' THEN 'bool' ELSE 'u64' END AS kind, count(*) AS n, CAST(sum(CASE event_type WHEN 'view' THEN 1 + strlen(props) WHEN 'signup' THEN 2 ELSE 9 END) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "value_bytes": """WITH n AS (SELECT event_id, '04' AS tag, lpad(hex(CAST(event_id - 5000 AS BIGINT)), 16, CASE WHEN event_id < 5000 THEN 'F' ELSE '0' END) AS h FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, '05', lpad(hex(CAST(18446744073709551615 - event_id AS UBIGINT)), 16, '0') FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')),
d AS (SELECT event_id, '01' || hex(props) AS data FROM events WHERE event_type = 'view' UNION ALL SELECT -event_id - 1, '02' || hex(props) FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '0601' ELSE '0600' END FROM events WHERE event_type = 'signup'
  UNION ALL SELECT event_id, tag || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] FROM n)
SELECT event_id, data, false AS empty FROM d""",
    "codec_roundtrip": "SELECT CASE event_type WHEN 'click' THEN 'f64' WHEN 'view' THEN 'String' WHEN 'purchase' THEN 'i64' WHEN 'signup' THEN 'bool' ELSE 'u64' END AS kind, count(*) AS n, CAST(0 AS BIGINT) AS n_differ FROM events GROUP BY 1",
    "memtable_running_size": "SELECT user_id % 16 AS stream, event_id AS seq, CAST(sum(length(props) + 17) OVER (PARTITION BY user_id % 16 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events",
    "memtable_freeze_segments": f"WITH RECURSIVE {SEGMENTS}, s AS (SELECT stream, k, size, size AS held, CAST(0 AS BIGINT) AS segment FROM w WHERE k = 1 UNION ALL SELECT w.stream, w.k, w.size, CASE WHEN s.held >= {FREEZE_BYTES} THEN w.size ELSE s.held + w.size END, s.segment + CASE WHEN s.held >= {FREEZE_BYTES} THEN 1 ELSE 0 END FROM s JOIN w ON w.stream = s.stream AND w.k = s.k + 1) SELECT stream, segment, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY stream, segment",
    "block_segments": f"WITH RECURSIVE {SEGMENTS}, s AS (SELECT stream, k, size, size AS held, CAST(0 AS BIGINT) AS segment FROM w WHERE k = 1 UNION ALL SELECT w.stream, w.k, w.size, CASE WHEN s.held + w.size >= {BLOCK_BYTES} THEN w.size ELSE s.held + w.size END, s.segment + CASE WHEN s.held + w.size >= {BLOCK_BYTES} THEN 1 ELSE 0 END FROM s JOIN w ON w.stream = s.stream AND w.k = s.k + 1) SELECT stream, segment, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY stream, segment",
    "stream_latest": f"WITH {LOG}, {LATEST} SELECT key, seq, value FROM latest WHERE NOT gone",
}
SQL["fifo_pick"] = (
    f"WITH {FILES}, "
    + "p1 AS (" + SQL["fifo_promote_prefix"].split(FILES, 1)[1].strip() + "), "
    + "p2 AS (" + SQL["fifo_cold_ttl"].split(FILES, 1)[1].strip() + "), "
    + "p3 AS (" + SQL["fifo_size_cap"].split(FILES, 1)[1].strip() + "), "
    + SQL["fifo_hot_merge"].split(FILES, 1)[1].strip().removeprefix(",").strip().replace(") SELECT file_id FROM k", "), p4 AS (SELECT file_id FROM k", 1)
    + f"), {COLD_PICK}"
    + ", every AS (SELECT 0 AS rank, 'Promote' AS action, file_id FROM p1 UNION ALL SELECT 1, 'ColdEvictTtl', file_id FROM p2 UNION ALL SELECT 2, 'ColdEvictSize', file_id FROM p3 UNION ALL SELECT 3, 'HotMerge', file_id FROM p4 UNION ALL SELECT 4, 'ColdCompact', file_id FROM p5) SELECT action, file_id FROM every WHERE rank = (SELECT min(rank) FROM every)"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
