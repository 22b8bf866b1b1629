import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import shards, urls
from tidemark.llm.queries import URL_RULES

A_Z = {c: c + 32 for c in range(65, 91)}


def judged(url, rules):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url else None
    host, path = (m[1].translate(A_Z), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_equal_plain_rules(spark):
    rnd = random.Random(1)
    rules = URL_RULES + [("a.b", "", "block"), ("a.b", "/x", "allow"), ("b", "/xyz/", "block"), ("com", "/de/deep/er", "allow"), ("b", "/long/" + "z" * 4000, "block")]
    hosts = ["net", "x.net", "Example.NET", "www.example.net", "notexample.net", "example.com", "a.b", "A.b:80", "c.a.b", "b", "", "org", "x.org.", "." * 300 + "net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/deep/er/x", "/xyz/1", "/x", "/xy?q=/en/", "#/en/", "?/", "/fr/\n/x", "/en/" + "y" * 9000, "é/en/", "/long/" + "z" * 5000]
    got_urls = [None, "", "no scheme", "http:/x", "://", "a://b://c"] + [rnd.choice(["http", "HTTPS", ""]) + "://" + rnd.choice(hosts) + rnd.choice(paths) for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(got_urls)] + [(3, "no scheme")] * 2, "page_id long, url string").withColumn("host", F.lit("x"))
    table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    want = sorted(((i, *judged(u, rules)) for i, u in [*enumerate(got_urls), (3, "no scheme"), (3, "no scheme")]), key=repr)
    for options in ({}, {"broadcast_bytes": 0}, {"prefix_digits": 1}):  # broadcast, shuffled with salts, and nearly all prefixes shared
        got = sorted((tuple(r) for r in urls.judge(pages, table, **options).collect()), key=repr)
        assert got == want
    plan = urls.judge(pages, table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [hash#" in plan and "[hash#" in plan and "digest#" not in plan.split("BroadcastHashJoin [")[1].split("]")[0]
    assert {r.verdict for r in urls.judge(pages, table.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), table).collect() == []


def dealt(spark, docs, parts, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Slot", F.lit("x")).repartition(parts)
    return sorted((tuple(r) for r in shards.shuffled(d, 24, **options).select("doc_id", "text", "shard", "slot").collect()), key=repr)


SMALL = {"bucket_bytes": 4000, "partition_bytes": 9000}


def test_shards_follow_the_law_of_rows(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice([None, "", "same text", f"text {i} " * rnd.randrange(30)])) for i in range(503)] + [(7, "twice")] * 40 + [(8, None)] * 300 + [(9, "big " * 50_000)]
    got = dealt(spark, docs, 3, **SMALL)
    assert sorted(((a, b) for a, b, _, _ in got), key=repr) == sorted(docs, key=repr)
    counts = [sorted(s for _, _, n, s in got if n == k) for k in range(24)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert got == dealt(spark, docs, 5, **SMALL)  # the partitioning of the input has no part in it
    other = dealt(spark, docs, 3, seed=43, **SMALL)
    assert sum(a == b for a, b in zip(got, other)) < 90
    assert dealt(spark, [], 1) == [] and dealt(spark, docs[:1], 1)[0][2:] == (0, 0)
    # Neighbours in the input don't stay neighbours, and copies of a row are spread over the shards.
    place = {a: (n, s) for a, _, n, s in got}
    assert sum(place[i + 1] == (place[i][0], place[i][1] + 1) for i in range(500) if i not in (6, 7, 8)) < 12
    assert len({n for a, b, n, _ in got if a == 8 and b is None}) == 24


def hash64(spark, sql):
    return spark.sql(f"SELECT {sql}").first()[0]


def test_places_equal_a_plain_shuffle(spark):
    """Partition, bucket, order and Fisher-Yates written out one row at a time."""
    import numpy as np

    docs = [(i, f"text {i} " * (i % 17)) for i in range(300)]
    sizes = [len(t) + shards.ROW_BYTES for _, t in docs]
    parts = -(-sum(sizes) // SMALL["partition_bytes"])
    buckets = -(-sum(sizes) // (parts * SMALL["bucket_bytes"]))
    h = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "xxhash64(42, doc_id, text) AS h").selectExpr("doc_id", f"pmod(h, {parts}) AS p", f"pmod(shiftrightunsigned(xxhash64(44, h), 1), {buckets}) AS b", "xxhash64(43, h) AS g")
    by = {}
    for r in sorted(h.collect(), key=lambda r: (r.p, r.b, r.g)):
        by.setdefault((r.p, r.b), []).append(r.doc_id)
    order = []
    for key in sorted(by):
        rows = by[key]
        rng = np.random.Generator(np.random.PCG64([42, *key]))
        draws = rng.random(len(rows) - 1) if len(rows) > 1 else []
        for i, u in zip(range(len(rows) - 1, 0, -1), draws):
            j = int(u * (i + 1))
            rows[i], rows[j] = rows[j], rows[i]
        order += rows
    starts = [-(-s * len(docs) // 24) for s in range(25)]
    want = {d: (s, k - starts[s]) for s in range(24) for k, d in enumerate(order) if starts[s] <= k < starts[s + 1]}
    assert parts > 2 and {a: (n, s) for a, _, n, s in dealt(spark, docs, 4, **SMALL)} == want


def test_the_query_carries_sizes_and_slots(spark, tmp_path):
    from tidemark.llm.queries import op7_sharding

    docs = [(i, [None, "", "é" * i, f"t{i}"][i % 4]) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op7_sharding(spark, str(tmp_path)).collect()
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows}
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs}
    counts = [sorted(r.slot for r in rows if r.shard == k) for k in range(24)]
    assert all(c == list(range(len(c))) for c in counts) and {len(c) for c in counts} == {8, 9}


def test_written_shards_read_back(spark, tmp_path):
    docs = [(i, f"t{i}") for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    back = shards.write_shards(d, f"file://{tmp_path}/s", 24, bucket_bytes=700, partition_bytes=1500)
    assert back.columns == ["doc_id", "text", "slot", "shard"] and back.count() == 100
    r = back.where("doc_id = 5").select(F.crc32(F.col("text").cast("binary")).alias("c")).first()
    assert r.c == zlib.crc32(b"t5")
