import random

import brute
from pyspark.sql import functions as F

from tidemark.llm import quality, suffixes


def rows_of(df, n_hit=True):
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), brute.sha(",".join(r["items"])), bool(r.spans)) for r in df.collect()), key=repr)


def made(seed=3):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "dé", "e1", "ff"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(12)] + [(None, "zz yy"), (3, None)]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1]
    docs = []
    for i in range(120):
        words = rnd.choices(vocab + ["q", "r"], k=rnd.choice([0, 2, 30, 200]))
        if i % 3 == 0:
            it = rnd.choice(items)[1] or ""
            k = rnd.randrange(len(words) + 1)
            words[k:k] = it.upper().split()
        docs.append((i, " .\n".join(words)))
    return docs + [(500, None), (501, ""), (501, ""), (502, items[5][1] * 3)], items


def test_decontamination_equals_brute_force(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.decontamination(docs, items), key=repr)
    assert rows_of(suffixes.mark(d, b)) == want
    assert rows_of(suffixes.mark(d, b, block_bytes=100)) == want  # several passes
    left = suffixes.decontaminate(d, b)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[5])


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.mark(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], d.schema)
    assert rows_of(suffixes.mark(one, b)) == [(1, 2, 0, 0, brute.sha(""), False)]


def test_longest_matches_are_rows_with_places(spark, monkeypatch):
    docs, items = made(7)
    items = [x for x in items if x[1]]
    word = lambda t: suffixes.words_of((t or "").encode())
    want = {}
    for name, text in items:
        w = word(text)
        for k in range(len(w)):
            size = min(10, len(w))
            for d, t in docs:
                v = word(t)
                for p in range(len(v)):
                    n = 0
                    while n < len(w) - k and p + n < len(v) and v[p + n] == w[k + n]:
                        n += 1
                    if n >= size and len(w) - k >= size:
                        key = (str(name) if name is not None else "null", k)
                        want[key] = min(want.get(key, (1, 0, 0)), (-n, d, p))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert len({n for n, _ in items}) == len(items) and len(want) > 3
    for options in ({}, {"block_bytes": 150}):
        got = {(r.item, r.item_word): (-r.n_words, r.doc_id, r.word) for r in suffixes.longest_matches(d, b, **options).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        for (name, k), (n, doc, p) in got.items():
            v, w = word(dict(docs)[doc]), word(dict((str(a) if a is not None else "null", t) for a, t in items)[name])
            assert v[p : p - n] == w[k : k - n]
    assert suffixes.longest_matches(d.limit(0), b).collect() == [] == suffixes.longest_matches(d, b.limit(0)).collect()


def test_an_item_longer_than_a_block_loses_no_window(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    docs = [(k, " ".join(words[k : k + 10])) for k in range(291)] + [(999, " ".join(words[:9] + words[50:59]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for size in (100, 333, 1 << 20):
        found = {r.doc_id: len(r["items"]) for r in suffixes.mark(d, b, block_bytes=size).collect()}
        assert found == {k: int(k != 999) for k, _ in docs}


def test_clashing_columns_keep_their_values(spark):
    docs, items = made()
    d = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], "doc_id long, text string, N_Words string, spans string, items string, old_spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 100):
        left = suffixes.decontaminate(d, b, block_bytes=size)
        assert left.columns == d.columns and {tuple(r)[2:] for r in left.collect()} == {("a", "b", "c", "d")}


def test_very_long_and_repeated_documents(spark):
    item = "alpha beta gamma delta one two three four five six seven"
    long = "filler words " * 150_000 + item + " more" * 1000
    d = spark.createDataFrame([(1, long), (1, long), (2, item.upper() * 1), (3, "nothing")], "doc_id long, text string")
    got = rows_of(suffixes.mark(d, spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")))
    assert got == sorted(brute.decontamination([(1, long), (1, long), (2, item.upper()), (3, "nothing")], [(5, item)]), key=repr)


def test_ledger_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "a b c a b c", "x", "#* <a|b>\n#* <a|b>\n \n", "é ü x 　 ñ"] + ["\n".join(" ".join(rnd.choices(["aa", "b", "C", "dé"], k=rnd.randrange(30))) for _ in range(rnd.randrange(9))) for _ in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("failed", F.lit("x"))
    rows = quality.apply_policy(quality.ledger(d), 1)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.kept) for r in rows.collect()}
    assert got == {i: brute.quality(t) for i, t in enumerate(texts)}


def test_two_policies_and_ablations_read_one_stored_ledger(spark, tmp_path):
    rnd = random.Random(6)
    docs = [(i, "\n".join(" ".join(rnd.choices(["aa", "B", "#", "dé", f"w{rnd.randrange(99)}"], k=rnd.randrange(40))) for _ in range(rnd.randrange(9)))) for i in range(150)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, FAILED string")
    rows = quality.write_ledger(d, f"{tmp_path}/ledger", keep=("FAILED",))
    assert "text" not in rows.columns and rows.columns.count("failed") == 1 and "FAILED" not in rows.columns
    failed = {r.doc_id: r.failed for r in rows.collect()}
    for version in (1, 2):
        m = quality.mask(version)
        assert {r.doc_id: r.kept for r in quality.apply_policy(rows, version).collect()} == {i: f & m == 0 for i, f in failed.items()}
        want = {}
        for rule in quality.POLICIES[version]:
            bit = 1 << list(quality.RULES).index(rule)
            want[rule] = (sum(f & bit > 0 for f in failed.values()), sum(f & m == bit for f in failed.values()), sum(f & m & ~bit == 0 for f in failed.values()), len(docs))
        assert {r.rule: tuple(r)[1:] for r in quality.ablations(rows, version).collect()} == want


def test_very_long_text(spark):
    text = "word other thing\n" * 60_000
    r = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (180_000, 59_999, 180_000, 60_000)


def test_ablations_count_what_each_rule_costs(spark):
    d = spark.createDataFrame([(1, "a"), (2, " ".join(f"w{i}" for i in range(60))), (3, "x y z " * 30), (4, "HELLO # " * 3)], "doc_id long, text string")
    rows = quality.ledger(d)
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without, r.n_docs) for r in quality.ablations(rows, 2).collect()}
    kept = quality.apply_policy(rows, 2).where("kept").count()
    assert kept == 1 and got["few_words"][0] == 2 and all(v[2] == kept + v[1] and v[3] == 4 for v in got.values())
    assert {r.rule: r.n_docs for r in quality.ablations(rows.limit(0), 1).collect()} == {"few_words": 0, "repeated_words": 0}
