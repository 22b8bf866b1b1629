import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec
from tidemark.functions.keys import CHANGELOG, VALUE
from tidemark.operators import merge, policy, read
from tidemark.operators.segment import segments
from tidemark.sources import log, manifest
from tidemark.sources.store import KVStore
from tidemark.streaming.ingest import ingest, latest_stream

RUN = "key binary, seq bigint, op string, value string"


def run(spark, rows, tier=0):
    return spark.createDataFrame([(bytearray(k.encode()), s, "delete" if v is None else "put", v) for s, (k, v) in enumerate(rows)], RUN)


def pairs(df):
    return {bytes(r.key).decode(): r.value for r in df.collect()}


@pytest.fixture
def three(spark):
    new = run(spark, [("key_2", None), ("key_5", "key_5_value")])
    mid = run(spark, [("key_1", "key_1_value_2"), ("key_4", "key_4_value")])
    old = run(spark, [("key_1", "key_1_value"), ("key_2", "key_2_value"), ("key_3", "key_3_value")])
    return [new, mid, old]


def test_merge_of_three_runs(three):
    got = merge.merge_runs(three).where(merge.is_put())
    assert pairs(got) == {"key_1": "key_1_value_2", "key_3": "key_3_value", "key_4": "key_4_value", "key_5": "key_5_value"}
    assert set(pairs(got.where(F.col("key").between(F.lit(b"key_2"), F.lit(b"key_4"))))) == {"key_3", "key_4"}


def test_deletes_and_repeats(spark):
    one = [("key_1", "key_1_value")]
    assert pairs(merge.live(run(spark, one + [("key_1", None)]))) == {}
    assert pairs(merge.live(run(spark, [("key_1", "key_1_value"), ("key_2", "key_2_value"), ("key_1", "newest_value")]))) == {"key_1": "newest_value", "key_2": "key_2_value"}
    rows = [("key_1", "v1"), ("key_2", "v2_old"), ("key_3", "v3"), ("key_2", "v2_new"), ("key_2", None)]
    assert pairs(merge.live(run(spark, rows))) == {"key_1": "v1", "key_3": "v3"}


def test_two_way_merge_lets_a_delete_win(three):
    got = {bytes(r.key).decode(): (r.op, r.value) for r in merge.two_way_merge(three[0], three[2]).collect()}
    assert got["key_2"] == ("delete", None) and got["key_1"] == ("put", "key_1_value") and len(got) == 4


def test_scan_bounds_and_byte_order(spark):
    rows = spark.createDataFrame([(bytearray([k]), k, "put", str(k)) for k in [*range(31), 0x80, 0xFF]], RUN)
    got = [bytes(r.key)[0] for r in read.scan(rows, b"\x04", b"\x0f").collect()]
    assert got == list(range(4, 16))
    assert read.scan(rows, b"\x0f", b"\x04").collect() == []
    assert [bytes(r.key)[0] for r in read.scan(rows, b"\x1e", b"\xff\x01").collect()] == [30, 0x80, 0xFF]
    assert read.get(rows, b"\x80").collect()[0].value == "128" and read.get(rows, b"zz").collect() == []


def test_concat_checks_order(spark, three):
    with pytest.raises(ValueError):
        merge.concat_runs([], [])
    with pytest.raises(ValueError):
        merge.concat_runs(three[:2], [(b"a", b"m"), (b"m", b"z")])
    assert merge.concat_runs(three[:2], [(b"a", b"l"), (b"m", b"z")]).count() == 4


FILES = "level int, file_id bigint, first_key binary, last_key binary, entries bigint, size bigint, created_at timestamp"


def files(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(lv, n, bytearray(a.encode()), bytearray(b.encode()), 1, size, datetime(2024, 1, 1, 0, 0, 0)) for lv, n, a, b, size in rows], FILES)


LEVELED = [(0, 6, "key_256", "key_511", 1 << 20), (0, 5, "key_34", "key_255", 1 << 20), (1, 3, "key_13", "key_21", 4096), (1, 4, "key_26", "key_52", 4096), (2, 1, "key_1", "key_5", 1024), (2, 2, "key_6", "key_11", 1024)]


def test_leveled_pick(spark):
    meta = files(spark, LEVELED)
    assert policy.pick_level(meta, policy.Leveled(max_levels=4)).first().level == 0
    task = {(r.side, r.file_id) for r in policy.level0_task(meta).collect()}
    assert task == {("input", 6), ("input", 5), ("overlap", 4)}
    lower = {(r.side, r.file_id) for r in policy.lower_task(meta, 1).collect()}
    assert lower == {("input", 3), ("overlap", 1)}


@pytest.mark.parametrize(
    "rows,change,want",
    [
        ([(0, 2, "a", "b", 512), (0, 1, "a", "b", 512)], {"hot_ttl_s": 0}, {("Promote", 1), ("Promote", 2)}),
        ([(0, 1, "a", "b", 512)], {}, set()),
        ([(2, 2, "a", "b", 1 << 20), (2, 1, "c", "d", 1 << 20)], {"cold_max_bytes": 1 << 20}, {("ColdEvictSize", 2)}),
        ([(0, n, "a", "b", 256 << 10) for n in (5, 4, 3, 2, 1)], {}, {("HotMerge", n) for n in (1, 2, 3, 4, 5)}),
        ([(1, 7, "a", "b", 512)], {"cold_ttl_s": 5}, {("ColdEvictTtl", 7)}),
    ],
)
def test_tiered_pick(spark, rows, change, want):
    base = {"hot_ttl_s": 3600, "max_hot": 4, "small_bytes": 1 << 20, "max_output_bytes": 4 << 20, "cold_max_bytes": 512 << 20}
    got = policy.pick_tiered(files(spark, rows), policy.Tiered(**base | change), policy.Leveled(), F.lit("2024-01-01 00:00:10").cast("timestamp"))
    assert {(r.action, r.file_id) for r in got.collect()} == want


def test_log_replay_stops_at_damage(spark):
    rows = [(1, 0, "put", b"a", b"1"), (1, 1, "put", b"b", b"2"), (1, 2, "put", b"c", b"3"), (2, 0, "delete", b"a", None)]
    entries = spark.createDataFrame([(m, p, o, bytearray(k), None if v is None else bytearray(v)) for m, p, o, k, v in rows], "memtable_id bigint, pos bigint, op string, key binary, value binary")
    crc = log.checksum(F.col("op"), F.col("key"), F.col("value"))
    stored = entries.withColumn("crc", F.when((F.col("memtable_id") == 1) & (F.col("pos") == 1), F.lit(0)).otherwise(crc))
    good = F.col("crc") == crc
    assert log.intact(stored, good).count() == 2
    got = {bytes(r.key): r.op for r in log.replay(stored, good).collect()}
    assert got == {b"a": "delete"}


def test_manifest_fold(spark):
    rows = [(1, "NewMemtable", 1), (2, "Flush", 1), (3, "NewMemtable", 2), (4, "Flush", 2), (6, "NewMemtable", 5)]
    records = [(p, k, i, None, None, None, None, None, None) for p, k, i in rows] + [(5, "CompactionResult", None, 0, 1, [1], [], [4], None)]
    got = spark.createDataFrame(records, manifest.RECORD)
    assert {(r.file_id, r.level) for r in manifest.live_files(got).collect()} == {(2, 0), (4, 1)}
    assert [r.id for r in manifest.unflushed(got).collect()] == [5]
    assert manifest.next_id(got).first().next_id == 6 and manifest.next_id(got.limit(0)).first().next_id == 1


def test_codec_round_trip(spark):
    from decimal import Decimal

    nan = float("nan")
    values = [
        ("String", "Lorem ipsum dolor sit amet.", b"\x01Lorem ipsum dolor sit amet."),
        ("String", "", b"\x01"),
        ("Bytes", bytes([1, 2, 3, 4, 5]), b"\x02\x01\x02\x03\x04\x05"),
        ("f64", 1.7976931348623157e308, b"\x03\xff\xff\xff\xff\xff\xff\xef\x7f"),
        ("f64", -0.0, b"\x03" + b"\x00" * 7 + b"\x80"),
        ("f64", float("inf"), b"\x03" + b"\x00" * 6 + b"\xf0\x7f"),
        ("f64", nan, b"\x03" + b"\x00" * 6 + b"\xf8\x7f"),
        ("i64", 2**63 - 1, b"\x04" + b"\xff" * 7 + b"\x7f"),
        ("i64", -2, b"\x04\xfe" + b"\xff" * 7),
        ("u64", Decimal(2**64 - 1), b"\x05" + b"\xff" * 8),
        ("bool", True, b"\x06\x01"),
        ("bool", False, b"\x06\x00"),
    ]
    kinds = ("String", "Bytes", "f64", "i64", "u64", "bool")
    rows = [(n, (k, *[v if k == x else None for x in kinds])) for n, (k, v, _) in enumerate(values)]
    from pyspark.sql import types as T

    df = spark.createDataFrame(rows, T.StructType().add("n", T.IntegerType()).add("v", VALUE))
    data = df.select("n", codec.encode(F.col("v")).alias("b"), codec.byte_size(F.col("v")).alias("size")).orderBy("n")
    got = data.collect()
    assert [bytes(r.b) for r in got] == [b for _, _, b in values] and [r.size for r in got] == [len(b) for _, _, b in values]
    back = data.select("n", codec.decode(F.col("b")).alias("v")).orderBy("n").collect()
    for (kind, value, _), r in zip(values, back):
        found = r.v[1 + kinds.index(kind)]
        assert r.v.kind == kind and (found == value or (value != value and found != found))
    bad = spark.createDataFrame([(bytearray(b),) for b in (b"", b"\x07x", b"\x03abc", b"\x01\xff\xfe", b"\x06")], "b binary")
    assert [r.v for r in bad.select(codec.decode(F.col("b")).alias("v")).collect()] == [None] * 5


def test_run_names(spark):
    from tidemark.functions.keys import run_file_name

    assert [r[0] for r in spark.createDataFrame([(7,), (123456,)], "n long").select(run_file_name(F.col("n"))).collect()] == ["sst-00007.sst", "sst-123456.sst"]


def test_bloom_sizes_and_probes(spark):
    got = spark.range(1).select(bloom.parameters(F.lit(1000)).alias("p")).first().p
    assert (got.bits, got.bits_per_key, got.probes) == (9585, 10, 6) and got.bytes == 1199
    keys = spark.range(50).select(F.col("id").cast("string").cast("binary").alias("key"))
    bits = keys.select(F.explode(bloom.probes(F.col("key"), F.lit(480), 6)).alias("bit")).distinct()
    missing = keys.select("key", F.explode(bloom.probes(F.col("key"), F.lit(480), 6)).alias("bit")).join(bits, "bit", "left_anti")
    assert missing.count() == 0


def test_small_bloom_filters_pass_few_others(spark):
    size = lambda n: bloom.stored_bits(bloom.parameters(n)["bits"])
    assert [r[0] for r in spark.createDataFrame([(1,), (6,), (7,), (1000,)], "n long").select(size(F.col("n"))).collect()] == [64, 64, 128, 9600]
    filters = spark.range(1, 21).select(F.col("id").alias("n"), size(F.col("id")).alias("bits"))
    own = filters.select("n", "bits", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select("n", "bits", F.concat(F.lit("own "), F.col("k")).cast("binary").alias("key"))
    at = own.select("n", "bits", F.explode(bloom.probes(F.col("key"), F.col("bits"), 6)).alias("bit")).groupBy("n", "bits", bloom.word_of(F.col("bit")).alias("w")).agg(F.bit_or(bloom.bit_in_word(F.col("bit"))).alias("b"))
    words = at.groupBy("n", "bits").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("words")).cache()
    passes = bloom.may_contain(F.col("words"), F.col("key"), F.col("bits"), 6)
    assert own.join(words, ["n", "bits"]).where(~passes).count() == 0
    others = words.select("n", "bits", "words", F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("k")).withColumn("key", F.concat(F.lit("other "), F.col("k")).cast("binary"))
    assert [r.n for r in others.where(passes).groupBy("n").count().where("count > 100").collect()] == []


def test_segments_reset(spark):
    rows = spark.createDataFrame([(0, k, s) for k, s in enumerate([5, 5, 1, 20, 3, 3, 3])], "stream int, seq bigint, size bigint")
    freeze = [r.segment for r in segments(rows, 10).orderBy("seq").collect()]
    blocks = [r.segment for r in segments(rows, 10, fits=True).orderBy("seq").collect()]
    assert freeze == [0, 0, 1, 1, 2, 2, 2] and blocks == [0, 1, 1, 2, 3, 3, 3]


def test_store_follows_a_dictionary(spark, tmp_path):
    rnd, model = random.Random(4), {}
    store = KVStore.open(spark, f"file://{tmp_path}/kv")
    keys = [b"\x00", b"a", b"a\x00", b"ab", b"\x80", b"\xff\xff", "ü".encode(), b"k" * 70_000]
    for step in range(6):
        for _ in range(12):
            k = rnd.choice(keys)
            if rnd.random() < 0.3:
                store.delete(k)
                model.pop(k, None)
            else:
                v = rnd.choice(["", "text", b"", b"\x01", 1.5, -7, True, "x" * 70_000])
                store.put(k, v)
                model[k] = v
        if step in (1, 2, 4):
            store.flush()
        if step == 3:
            while store.compact():
                pass
        if step == 4:
            store = KVStore.open(spark, store.path)  # as after a crash: everything was flushed
        found = {bytes(r.key): r.value for r in store.live().collect()}
        assert set(found) == set(model)
    from tidemark.sources.store import plain

    assert {k: plain(v) for k, v in found.items()} == model
    low, high = b"a", b"ab"
    assert [bytes(r.key) for r in store.scan(low, high).collect()] == sorted(k for k in model if low <= k <= high)
    assert store.scan(high, low).collect() == []
    for k in (b"a", b"\x80", b"nothing"):
        assert store.get(k) == model.get(k)
    store.put(b"big", 2**64 - 1, "u64")
    store.close()
    again = KVStore.open(spark, store.path)
    assert again.get(b"big") == 2**64 - 1
    again.compact_all()
    again.vacuum(0)
    assert again.state.runs and all(r["level"] >= 1 for r in again.state.runs) and again.changelog().where("op = 'delete'").count() == 0
    assert {bytes(r.key) for r in again.live().collect()} == set(model) | {b"big"}


def i64(n):
    return ("i64", None, None, None, n, None, None)


def changes(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, "delete" if v is None else "put", None if v is None else i64(v)) for k, s, v in rows], CHANGELOG)


def test_late_changes_dont_bring_deleted_keys_back(spark, tmp_path):
    store = KVStore.open(spark, f"file://{tmp_path}/kv")
    store.write_log(changes(spark, [(b"k", 1, 1), (b"m", 2, 2)]))
    store.write_log(changes(spark, [(b"k", 7, None)]))
    store.compact_all()
    store.write_log(changes(spark, [(b"k", 5, 5), (b"m", 6, 6)]))  # late: the delete is still there
    assert store.get(b"k") is None and store.get(b"m") == 6
    store.compact_all()
    store.advance(9)
    store.compact_all()
    assert store.changelog().where("op = 'delete'").count() == 0 and store.get(b"k") is None and store.state.floor == 7
    with pytest.raises(ValueError):
        store.write_log(changes(spark, [(b"k", 5, 5)]))
    store.write_log(changes(spark, [(b"k", 5, 5), (b"n", 20, 20)]), late="drop")
    assert store.get(b"k") is None and store.get(b"n") == 20
    own = KVStore.open(spark, f"file://{tmp_path}/own")  # without late changes deletes go at the bottom
    own.put(b"k", 1)
    own.delete(b"k")
    own.compact_all()
    assert own.changelog().count() == 0 and own.state.floor == 2
    with pytest.raises(ValueError):
        own.write_log(changes(spark, [(b"k", 1, 1)]))


def test_scans_outlive_flush_and_compaction(spark, tmp_path):
    store = KVStore.open(spark, f"file://{tmp_path}/kv")
    store.put(b"a", 1)
    store.sync()
    before = store.scan(b"a", b"z")
    store.flush()
    flushed = store.scan(b"a", b"z")
    store.put(b"b", 2)
    store.compact_all()
    store.vacuum()
    assert [bytes(r.key) for r in before.collect()] == [b"a"] == [bytes(r.key) for r in flushed.collect()]
    assert [bytes(r.key) for r in store.scan(b"a", b"z").collect()] == [b"a", b"b"]
    assert len(store.state.retired) == 4
    store.vacuum(0)
    assert store.state.retired == [] and len(store._list("runs")) == 1 and store._list("log") == [] and len(store._versions()) == 1
    assert store.get(b"a") == 1 and KVStore.open(spark, store.path).get(b"b") == 2


def test_writes_survive_crashes_and_failed_syncs(spark, tmp_path):
    store = KVStore.open(spark, f"file://{tmp_path}/kv")
    values = {b"alpha": "value_a", b"beta": b"\x00\xff", b"c": -1.5, b"d": 2**64 - 1, b"e": True, b"": ""}
    for k, v in values.items():
        store.put(k, v, "u64" if k == b"d" else None)
    store.delete(b"c")
    real, store._log = store._log, lambda rows: (_ for _ in ()).throw(OSError("disk full"))
    with pytest.raises(OSError):
        store.sync()
    assert store.get(b"alpha") == "value_a"  # still buffered
    crashed = KVStore.open(spark, store.path)
    assert {bytes(r.key) for r in crashed.live().collect()} == set(values) - {b"c"}
    assert all(crashed.get(k) == v for k, v in values.items() if k != b"c") and crashed._list("wal") == []
    crashed.put(b"alpha", "newer")
    crashed.put(b"last", 1)
    path = crashed.wal[0].removeprefix("file:")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])  # the last write was cut off
    again = KVStore.open(spark, store.path)
    assert again.get(b"alpha") == "newer" and again.get(b"last") is None
    again.put(b"alpha", "newest")
    assert again.get(b"alpha") == "newest"
    again.close()
    assert KVStore.open(spark, store.path).get(b"alpha") == "newest"


def test_buffers_freeze_and_are_logged_together(spark, tmp_path):
    store = KVStore.open(spark, f"file://{tmp_path}/kv", max_buffer=10)
    store.put(b"a", "x" * 20)
    store.put(b"b", "x" * 20)
    assert len(store.frozen) == 2 and store.state.logs == [] and store.get(b"a") == "x" * 20
    store.put(b"a", "y" * 20)
    assert store.frozen == [] and len(store.state.logs) == 1 and store.get(b"a") == "y" * 20


def tiered(**change):
    base = {"hot_ttl_s": 10**6, "max_hot": 10**6, "small_bytes": 1 << 30, "max_output_bytes": 1 << 40, "cold_max_bytes": 1 << 40}
    return policy.Tiered(**base | change)


def test_tiered_actions_are_carried_out(spark, tmp_path):
    now = [0.0]
    store = KVStore.open(spark, f"file://{tmp_path}/kv", clock=lambda: now[0])
    for n, rows in enumerate([{b"a": 1, b"b": 1}, {b"a": 2, b"c": 2}, {b"b": None, b"d": 3}, {b"c": None, b"e": 4}]):
        now[0] = 100.0 * n
        for k, v in rows.items():
            store.put(k, v) if v is not None else store.delete(k)
        store.flush()
    state = lambda: {bytes(r.key): r.value.i for r in store.live().collect()}
    every = {b"a": 2, b"d": 3, b"e": 4}
    assert state() == every and store.compact(tiered()) is None
    assert store.compact(tiered(max_hot=3, max_output_bytes=sum(r["size"] for r in store.state.runs[2:]))) == "HotMerge"
    assert [(r["level"], r["id"], r["entries"], r["created"]) for r in store.state.runs][-1] == (0, 2, 3, 100.0) and len(store.state.runs) == 3 and state() == every
    assert store.compact(tiered(hot_ttl_s=100)) == "Promote"  # runs of 100 and 200, not that of 300
    assert [r["level"] for r in store.state.runs] == [0, 1, 1] and state() == every
    small = policy.Leveled(base_bytes=1)
    assert store.compact(tiered(), small) == "ColdCompact" and sorted(r["level"] for r in store.state.runs) == [0, 1, 2] and state() == every
    assert store.compact(tiered(), small) == "ColdCompact" and state() == every  # the deletes held back older versions till now
    cold = [r for r in store.state.runs if r["level"]]
    now[0] = min(r["created"] for r in cold) + 50
    assert store.compact(tiered(cold_ttl_s=51)) is None
    now[0] = max(r["created"] for r in cold) + 50
    assert store.compact(tiered(cold_ttl_s=50)) == "ColdEvictTtl" and all(r["level"] == 0 for r in store.state.runs) and state() == {b"e": 4}
    assert store.compact(tiered(hot_ttl_s=0)) == "Promote" and store.compact(tiered(cold_max_bytes=0)) == "ColdEvictSize" and state() == {}
    assert KVStore.open(spark, store.path).state == store.state


def test_multi_get_and_empties(spark, tmp_path):
    store = KVStore.open(spark, f"file://{tmp_path}/kv")
    for n in range(5):
        store.put(bytes([n]), n)
        store.flush()
    keys = spark.createDataFrame([(bytearray(b"\x01"),), (bytearray(b"\x02"),), (bytearray(b"\x02"),)], "key binary")
    got = store.multi_get(keys)
    assert sorted(r.value.i for r in got.collect()) == [1, 2] and len(got.inputFiles()) == 2
    assert store.multi_get(keys.limit(0)).collect() == []
    rows = spark.createDataFrame([("put", bytearray(b"")), ("put", bytearray(b"x")), ("delete", None)], "op string, b binary")
    assert [r.e for r in rows.select(codec.is_empty(F.col("op"), F.col("b")).alias("e")).collect()] == [True, False, True]


def test_second_writer_fails(spark, tmp_path):
    a = KVStore.open(spark, f"file://{tmp_path}/kv")
    b = KVStore.open(spark, f"file://{tmp_path}/kv")
    a.put(b"k", 1)
    a.sync()
    b.put(b"k", 2)
    with pytest.raises(RuntimeError):
        b.sync()
    assert KVStore.open(spark, a.path).get(b"k") == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray([k % 7]), k, "delete" if k % 5 == 0 else "put", ("i64", None, None, None, k, None, None)) for k in range(60)], CHANGELOG)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema(CHANGELOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = KVStore.open(spark, f"file://{tmp_path}/kv")
    ingest(changes, store, f"{tmp_path}/check", compact_every=2).awaitTermination()
    query = latest_stream(changes).writeStream.outputMode("complete").format("memory").queryName("latest_view").option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(bytes(r.key), r.seq, r.op) for r in merge.latest_wins(rows).collect()}
    assert {(bytes(r.key), r.seq, r.op) for r in spark.table("latest_view").collect()} == want
    assert {bytes(r.key) for r in store.live().collect()} <= {k for k, _, _ in want}
