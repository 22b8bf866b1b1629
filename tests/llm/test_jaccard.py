import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.common import Scratch


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = rnd.choices(vocab, k=60)
    docs = []
    for i in range(n):
        kind = rnd.random()
        if docs and kind < 0.6:
            words = rnd.choice(docs[-40:])[1].split() or ["x"]
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                words += rnd.choices(vocab, k=2)
        else:
            words = rnd.choices(vocab, k=rnd.choice([0, 1, 2, 3, 5, 20, 60, 150])) + (passage if kind > 0.85 else [])
        docs.append((i * 3 + 1, " ".join(words)))
    return docs + [(2, None), (5, " \n"), (8, "Solo"), (11, "sOLO")]


@pytest.mark.parametrize("seed,size,num,frequent", [(1, 3, 90, 32), (2, 3, 90, 3), (3, 5, 80, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, size, num, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("v", F.lit(0)).repartition(3)
    got = sorted(map(tuple, jaccard.grouped(d, size=size, num=num).collect()))
    assert got == sorted(brute.jaccard_components(docs, size, num))


@pytest.mark.parametrize("option,value", [("FAT_POSTINGS", 10), ("BLOCK_BYTES", 3000), ("digest", 6), ("SHIPPED_FREQUENT", 5)])
def test_other_ways_give_the_same(spark, monkeypatch, option, value):
    """Fat buckets, large blocks dealt into parts, digests that clash in the bits the search carries, and few frequent shingles."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    if option == "digest":
        whole = jaccard.digest
        monkeypatch.setattr(jaccard, "digest", lambda tokens: ((d := whole(tokens))[0] % value, d[1]))
    else:
        monkeypatch.setattr(jaccard, option, value)
        if option == "BLOCK_BYTES":
            for f in (jaccard.blocks, jaccard.split_blocks, jaccard.links):
                monkeypatch.setattr(f, "__defaults__", (value,))
    docs = corpus(11, 120)
    d = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").repartition(3)
    got = sorted(set(map(tuple, jaccard.grouped(d, size=3, num=90).collect())))
    if option == "digest":  # classes that clash and have no other partner don't meet each other
        got, docs = [x for x in got if x[1] > 0], [x for x in docs if x[1] and x[1].strip()]
    assert got == sorted(brute.jaccard_components(docs, 3, 90))


def test_split_blocks_lose_no_link(spark):
    docs = corpus(7, 80)
    sets = {doc: jaccard.shingles((t or "").encode(), 3) for doc, t in docs}
    rows = [(doc, s.tobytes()) for doc, s in sets.items() if len(s)]
    table = spark.createDataFrame([(v, v, bytearray(t)) for v, t in rows], "v long, u long, tokens binary")
    met = table.select(F.lit(0).cast("long").alias("hub"), "v", "u", "tokens")
    for size, seeds in ((1 << 20, 32), (4000, 32), (4000, 0)):  # one block; parts with seeds; parts that only visits connect
        jaccard.SEEDS = seeds
        parts = jaccard.split_blocks(met.select("hub", F.octet_length("tokens").alias("size")), size)
        assert parts.count() == (size == 4000)
        with Scratch(spark) as scratch:
            found = jaccard.links(met, parts, 90, 100, scratch, size)
            got = {int(r.v[:16], 16): int(r.label[:16], 16) for r in jaccard.components(found).collect()}
        want = {d: c for d, _, c in brute.jaccard_components(docs)}
        assert all(got.get(d, d) == c for d, c in want.items())
    jaccard.SEEDS = 32


def test_skipped_lists_keep_exact_overlaps():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rnd.choice(400, rnd.integers(5, 40), replace=False)] = rnd.integers(0, 1 << 60, 1)
        sets.append(np.unique(own))
    forest = jaccard.Forest(60)
    for a, b in jaccard.links_within(sets, None, 90, 100):
        n = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n)
        x, y = sorted((forest.top(a), forest.top(b)))
        forest.up[y] = x
    other = jaccard.Forest(60)
    for a in range(60):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((other.top(a), other.top(b)))
                other.up[y] = x
    same = lambda f: [[f.top(a) == f.top(b) for b in range(60)] for a in range(60)]
    assert same(forest) == same(other)


def test_empty_table_and_shared_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.grouped(empty).collect() == []
    d = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "E f g h"), (None, "a b c d"), (None, "q r s t")], empty.schema)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.grouped(d).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None)], key=repr)
    assert sorted(r.text for r in jaccard.keep_one(d, size=3, num=90).collect()) == ["a b c d", "e f g h", "q r s t"]


def test_keep_one_leaves_one_row_a_group_and_all_columns(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    near = [*words[:40], "new", *words[40:]]
    base, other = " ".join(words), " ".join(near)
    rows = [(5, base), (3, other), (3, "clean text of its own that stays here"), (None, other), (None, "x y z a b c d"), (None, "x y z a b c d"), (9, None), (9, None), (4, ""), (7, base), (3, other), (3, other)]
    d = spark.createDataFrame([(i, t, "p", "q", "r", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _gone string, _id string, LABEL string, k int").repartition(3)
    left = jaccard.keep_one(d)
    got = left.collect()
    assert left.columns == d.columns and {(r._gone, r._id, r.LABEL) for r in got} == {("p", "q", "r")}
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(3, other), (3, "clean text of its own that stays here"), (None, "x y z a b c d"), (9, None), (9, None), (4, "")], key=repr)
    assert jaccard.keep_one(d.limit(0)).collect() == [] and jaccard.keep_one(d.where("k IN (2, 6, 8)")).count() == 3


def test_very_long_text(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(120_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:119_000])), (3, " ".join(words[60_000:]))]
    got = {r.doc_id: r.component_id for r in jaccard.grouped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
