import random
import re

from pyspark.sql import functions as F

from tidemark.llm import lines


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs):
    words = lambda s: tuple(re.findall(r"[^\x20\x09-\x0D]+", s))
    first = {}
    for d, t in sorted(docs):
        for ln, s in enumerate(t.split("\n")):
            w = words(s)
            if len(w) >= lines.MIN_WORDS:
                first.setdefault(w, (d, ln))
    near = {w for w in first if len(w) >= lines.FUZZY_WORDS and any(len(v) >= lines.PARTNER_WORDS and first[v] < first[w] and edit_at_most_one(v, w) for v in first)}
    out = {}
    for d, t in docs:
        kept = [s for ln, s in enumerate(t.split("\n")) if len(words(s)) < lines.MIN_WORDS or (first[words(s)] == (d, ln) and words(s) not in near)]
        out[d] = "\n".join(kept), t.count("\n") + 1 - len(kept)
    return out


def made(seed):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(40)]
    pool = [rnd.choices(vocab, k=rnd.choice([2, 4, 5, 8, 10, 11, 12, 25, 40])) for _ in range(30)]
    docs = []
    for d in range(60):
        text = []
        for _ in range(rnd.randrange(8)):
            w = list(rnd.choice(pool)) if rnd.random() < 0.8 else rnd.choices(vocab, k=20)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                k, how = rnd.randrange(len(w)), rnd.random()
                if how < 0.4:
                    w[k] = rnd.choice(vocab)
                elif how < 0.7:
                    w.insert(k, rnd.choice(vocab))
                elif len(w) > 1:
                    del w[k]
            text.append(rnd.choice(["", " "]) + rnd.choice([" ", "\t", "  "]).join(w))
        docs.append((d, "\n".join(text)))
    docs.append((900, "\n".join(f"line number {i} of many that are alike ok yes it is so" for i in range(200)) * 2))
    return docs


def test_dedup_equals_brute_force(spark):
    for seed in (1, 2):
        docs = made(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_removed", F.lit("x")).withColumn("line", F.lit(1)).repartition(3)
        got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(d).collect()}
        assert got == plain(docs)


def test_nulls_repeats_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(lines, "small", lambda *_: False)
    a, b = "one two three four five", "six seven eight nine ten"
    d = spark.createDataFrame([(1, None), (2, ""), (3, f"{a}\n{b}"), (3, f"{a}\n{b}"), (4, f"{b}\nshort\n{a}\nshort"), (None, b)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(d).collect()), key=repr)
    assert got == sorted([(1, None, 0), (2, "", 0), (3, a, 1), (3, a, 1), (4, "short", 3), (None, b, 0)], key=repr)
    assert lines.dedup_lines(d.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    d = spark.createDataFrame(made(3)[:5], "doc_id long, text string")
    plan = lines.dedup_lines(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_line_equals_brute_force(spark):
    rnd, vocab = random.Random(7), [f"v{i}" for i in range(9)]
    docs = [(d, "\n".join(" ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 4, 5, 5, 6, 9, 10]))) for _ in range(40))) for d in range(40)]
    pool = [rnd.choices(vocab, k=k) for k in (4, 5, 6, 9, 10, 11)]
    for d in range(40, 70):  # and lines near each other
        w = list(rnd.choice(pool))
        w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append((d, " ".join(w) + "\n" + " ".join(w[:3] + [rnd.choice(vocab)] + w[3:]) + "\nAll rights reserved.\n"))
    first, want = {}, {}
    for d, t in docs:
        for ln, s in enumerate(t.split("\n")):
            first.setdefault(tuple(s.split()), (d, ln))
    near = {w for w in first if len(w) >= 5 and any(len(v) >= 4 and first[v] < first[w] and edit_at_most_one(v, w) for v in first)}
    for d, t in docs:
        want[d] = "\n".join(s for ln, s in enumerate(t.split("\n")) if not s or (first[tuple(s.split())] == (d, ln) and tuple(s.split()) not in near))
    assert any(len(w) == 5 for w in near) and any(len(w) < 10 for w in near)
    rows = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in rows} == want


def test_ten_words_near_nine(spark):
    nine = "one two three four five six seven eight nine"
    d = spark.createDataFrame([(1, nine), (2, nine + " ten"), (3, "Les."), (4, "Les.\nLes.\nmore")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(d).collect()} == {1: nine, 2: "", 3: "Les.", 4: "more"}


def test_every_pair_of_short_lines(spark):
    """All lines of four to six words over three words: the keys of halves let every pair through."""
    from itertools import product

    every = [w for n in (4, 5, 6) for w in product("abc", repeat=n)]
    random.Random(3).shuffle(every)
    docs = [(i, " ".join(w)) for i, w in enumerate(every)]
    at = {w: i for i, w in enumerate(every)}

    def near(w):
        for i in range(len(w)):
            yield w[:i] + w[i + 1 :]
            for x in "abc":
                yield w[:i] + (x,) + w[i + 1 :]
        for i in range(len(w) + 1):
            for x in "abc":
                yield w[:i] + (x,) + w[i:]

    gone = {at[w] for w in every if len(w) >= 5 and any(at.get(v, 10**9) < at[w] for v in near(w) if len(v) >= 4)}
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed = 1").collect()}
    assert got == gone and len(gone) > 300


def test_long_lines_and_clashing_columns(spark):
    rnd = random.Random(5)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    less, more, other = long[:30_000] + long[30_001:], long[:255] + ["new"] + long[255:], long[:-1] + ["other"]
    two = long[:10] + ["x"] + long[11:50_000] + ["y"] + long[50_001:]
    docs = [(i, " ".join(w), "a", "b", "c", "d", "e", "f") for i, w in enumerate([long, less, more, other, two, long[:256], long[:257], long[:511], long[:512]])]
    d = spark.createDataFrame(docs, "doc_id long, text string, _t string, _gone string, _id string, _R string, N_REMOVED string, words string")
    rows = lines.dedup_lines(d).collect()
    assert {r.doc_id for r in rows if r.n_removed} == {1, 2, 3, 6, 8}
    assert rows[0].asDict().keys() == {"doc_id", "text", "_t", "_gone", "_id", "_R", "words", "n_removed"}
    assert {(r._t, r._gone, r._id, r._R, r.words) for r in rows} == {("a", "b", "c", "d", "f")}


def test_no_plan_starts_many_stages(spark):
    """The driver's heap grows by what each stage takes that one plan starts beside others."""
    store = spark._jsparkSession.sharedState().statusStore()
    docs = spark.createDataFrame([(i, f"one two three four five six w{i % 3}\nalone {i}") for i in range(12)], "doc_id long, text string")
    before = store.executionsCount()
    lines.dedup_lines(docs).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    jobs = [runs.apply(k).jobs().size() for k in range(int(before), runs.size())]
    assert len(jobs) > 8 and max(jobs) <= 9, jobs
