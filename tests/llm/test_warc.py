import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc


def sha(b):
    return hashlib.sha1(b).hexdigest()


def made(n=20, seed=1):
    rnd = random.Random(seed)
    return [warc.record(i, f"http://x/{i}", p, sha(p), None) for i in range(n) for p in [("<p>%d</p>" % i).encode() * rnd.randrange(1, 200)]]


def ids(data):
    return [x[3]["id"] for x in warc.salvage(warc.Bytes(data)) if x[0] == "record"]


def gaps(data):
    return [x[1:3] for x in warc.salvage(warc.Bytes(data)) if x[0] == "gap"]


def test_intact_archives_have_no_gap():
    for pack in (warc.member, bytes):
        data = b"".join(map(pack, made()))
        assert ids(data) == [str(i) for i in range(20)] and gaps(data) == []
    assert ids(gzip.compress(b"".join(made(3)))) == ["0", "1", "2"]  # several records in one member
    assert ids(b"") == [] and gaps(b"") == []


def test_later_records_are_recovered():
    for pack in (warc.member, bytes):
        parts = list(map(pack, made()))
        starts = [sum(map(len, parts[:k])) for k in range(21)]
        data = bytearray(b"".join(parts))
        data[starts[4] + len(parts[4]) // 2] ^= 0x55  # a flipped byte
        data[starts[9] : starts[9] + 5] = b"\0" * 5  # a broken start
        got = ids(bytes(data))
        assert got == [str(i) for i in range(20) if i not in (4, 9)]
        assert gaps(bytes(data)) == [(starts[4], starts[5]), (starts[9], starts[10])]
        cut = bytes(data[: starts[20] - 7])  # the last record is cut short
        assert ids(cut) == [x for x in got if x != "19"] and gaps(cut)[-1] == (starts[19], len(cut))
        junk = b"junk" * 50 + bytes(parts[0]) + b"WARC/1.0\r\nContent-Length: 99999\r\n\r\n" + bytes(parts[1]) + b"\x1f\x8b\x08"
        assert ids(junk) == ["0", "1"] and len(gaps(junk)) == 3


def test_random_damage_never_hides_distant_records():
    rnd = random.Random(5)
    parts = list(map(warc.member, made(30)))
    for _ in range(40):
        k = rnd.randrange(30)
        data = bytearray(b"".join(parts))
        at = sum(map(len, parts[:k])) + rnd.randrange(len(parts[k]))
        del data[at : at + rnd.randrange(1, 9)]
        got = ids(bytes(data))
        assert set(map(str, range(30))) - set(got) <= {str(k), str(k + 1)}


def test_pages_go_round(spark, tmp_path, monkeypatch):
    long, other = "<html>é" + "x" * 1200, "y" * 999
    pages = [(1, "http://a", long), (5, None, long), (9, "http://b\r\nX: y", long), (2, "u", other), (3, "u", other), (4, "u", None), (6, "u", ""), (9, "again", long), (None, "n", long)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    want = set()
    for i, _, h in pages:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and i is not None and i != 9
        want.add((i, len(b), sha(b), "revisit" if revisit else "response", 9 if revisit else None))
    for k, limit in enumerate((100, 0)):
        monkeypatch.setattr(warc, "small", lambda *_, limit=limit: bool(limit))  # broadcast, and shuffled
        manifest = warc.write_archives(d, f"file://{tmp_path}/{k}", archive_bytes=600)
        assert manifest.agg(F.sum("records")).first()[0] == len(pages)
        rows = warc.read_archives(spark, manifest).collect()
        got = {(r.id and int(r.id), r.payload_bytes, r.payload_digest, r.type, r.refers_to and int(r.refers_to)) for r in rows}
        assert len(rows) == len(pages) and got == want
        assert {bytes(r.payload) for r in rows if r.type == "response"} == {(h or "").encode() for _, _, h in pages}
    empty = warc.write_archives(d.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read_archives(spark, empty).collect() == []
    lost = spark.createDataFrame([(f"file://{tmp_path}/none.warc.gz",)], "path string")
    assert [r.kind for r in warc.read_archives(spark, lost).collect()] == ["gap"]


def test_records_of_a_damaged_member_are_recovered():
    parts = made(40, 3)
    content = bytearray(b"".join(parts))
    content[sum(map(len, parts[:7])) + len(parts[7]) - 9] ^= 1  # a payload byte, under an intact gzip stream
    content[sum(map(len, parts[:20])) : sum(map(len, parts[:20])) + 4] = b"JUNK"
    one = gzip.compress(bytes(content))
    last = warc.member(warc.record(99, "u", b"z", sha(b"z"), None))
    assert ids(one + last) == [str(i) for i in range(40) if i not in (7, 20)] + ["99"]
    assert gaps(one + last) == [(0, len(one))] * 2
    for level in (0, 9):  # a stream that breaks in the middle
        whole = gzip.compress(b"".join(parts), level)
        for bad in (whole[: len(whole) * 2 // 3], whole[: len(whole) * 2 // 3] + b"\xff" * 40, whole[:-8] + b"\0" * 8):
            got = ids(bad + last)
            assert got[-1] == "99" and got[:-1] == [str(i) for i in range(len(got) - 1)] and len(got) > 15 and gaps(bad + last)
    bare = b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert ids(gzip.compress(bare)) == [None] and ids(gzip.compress(bare)[:-8] + b"\0" * 8) == []  # nothing shows that it is whole


def test_long_headers_and_separators_in_urls(spark, tmp_path):
    urls = ["http://x/" + "a" * (warc.CHUNK * 2 + 5), "http://x/\x85b", "http://x/\u2028b\u2029", "\u2028http://x/\x85", "http://x/\x0b\x1c"]
    for pack in (warc.member, bytes):
        data = b"".join(pack(warc.record(i, u, b"p", sha(b"p"), None)) for i, u in enumerate(urls))
        got = [x[3]["url"] for x in warc.salvage(warc.Bytes(data)) if x[0] == "record"]
        assert got == [*urls[:4], "http://x/%0B%1C"] and gaps(data) == []
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("p"))
    manifest = warc.write_archives(d, f"file://{tmp_path}/a")
    assert warc.read_archives(spark, manifest, records_col="records").where("kind = 'record'").count() == len(urls)
    with pytest.raises(Exception, match="records read"):
        warc.read_archives(spark, manifest.withColumn("records", F.col("records") + 1), records_col="records").collect()


def test_an_archive_is_fetched_once(tmp_path):
    import os

    rnd = random.Random(6)
    for pack in (warc.member, bytes):
        path = f"{tmp_path}/{pack.__name__}.warc"
        with open(path, "wb") as f:
            for i in range(3000):
                p = rnd.randbytes(rnd.choice([0, 40, 900, 5000]))
                f.write(pack(warc.record(i, "u", p, sha(p), None)))
            big = rnd.randbytes(3 * warc.CHUNK)
            f.write(pack(warc.record("big", "u", big, sha(big), None)))
        store, name = warc.filesystem(f"file://{path}")
        source = warc.Bytes(file=store.open_input_file(name))
        got = [x[3]["id"] for x in warc.salvage(source)]
        assert got == [*map(str, range(3000)), "big"] and source.fetched <= 1.1 * os.path.getsize(path)


def test_the_query_returns_every_page(spark, tmp_path):
    from tidemark.llm.queries import op4_warc

    pages = [(i, None if i == 3 else f"http://x/{i}\u2028\x85", [None, "", "k" * 1000, "é" * 700_000][i % 4]) for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op4_warc(spark, str(tmp_path)).collect()}
    for i, _, h in pages:
        b = (h or "").encode()
        keeper = max(j for j, _, x in pages if x == h)
        again = len(b) >= 1000 and i != keeper
        assert got[i] == (len(b), sha(b), "revisit" if again else "response", keeper if again else None)
