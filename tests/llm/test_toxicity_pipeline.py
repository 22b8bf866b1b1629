import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity

CLEAN = "the of and in to that was with for here there lines words simple nice garden river stone".split()
BAD = "moron idiotic scumbag lowlife".split()


def made(n=400, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(CLEAN, k=rnd.randrange(30, 90))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "s", "ly", "."]))
        docs.append((i, " ".join(words), "en", "src", 0))
        if i % 5:
            labels.append((i, 1, int(bad)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = made()
    docs += [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, "Ü" * 50_000, None, None, 1), (3, docs[3][1], "en", "src", 0)]
    labels += [(5, 1, None), (None, 1, 1), (77777, 1, 1), (3, 0, 0)]
    d, lab = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("x")), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(d, lab)
    rows = toxicity.score(d, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score >= 0.3, r.doc_id % 4 == 0) for r in rows if r.out and r.doc_id < 400]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    by = {r.doc_id: r.score for r in rows}
    assert by[1000] == by[1001] < 0.3
    again = toxicity.fit(d.repartition(5), lab.repartition(3))
    assert abs(again[1] - model[1]) < 1e-6 and abs(again[0] - model[0]).max() < 1e-6  # the same whatever the partitioning
    d = d.withColumn("_score", F.lit("y")).withColumn("_H", F.lit("z"))
    left = toxicity.reject_toxic(d, lab)
    assert {(r.score, r._score, r._H) for r in left.collect()} == {("x", "y", "z")}
    upper = d.drop("score").withColumnRenamed("_score", "Score")
    assert {r.Score for r in toxicity.reject_toxic(upper, lab).collect()} == {"y"}
    assert left.columns == d.columns and left.where("doc_id IN (0, 4, 8)").count() == 0 and left.where("doc_id IN (1, 2, 5)").count() == 3


def test_without_labels_or_with_one_class(spark):
    docs, labels = made(40)
    d = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {round(r.score, 6) for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1, 1) for i in range(40)], LABELS)
    assert {round(r.score, 6) for r in toxicity.score(d, toxicity.fit(d, ones)).collect()} == {1.0}
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), none)).collect() == []


def test_sample_takes_repeats_once_and_long_texts_at_last(spark):
    docs, labels = made(60)
    long = [(i, t + " calm" * 5000 + f" n{i}", a, b, c) for i, t, a, b, c in docs]
    d, lab = spark.createDataFrame(docs + [docs[4]] * 50 + [(900, docs[4][1], "en", "s", 0)], DOCS), spark.createDataFrame(labels + [(900, 1, 1)], LABELS)
    rows, texts = toxicity.labelled(d, lab, "doc_id", "text", "toxic"), toxicity.texts_of(d, "doc_id", "text")
    every = np.ones(toxicity.SIZE, bool)
    lists, y = toxicity.fit_sample(rows, texts, 10, 20_000, every)
    assert len(lists) == 20 and y.sum() == 10 and len({f.tobytes() for f in lists}) == 20
    d = spark.createDataFrame(long, DOCS)
    rows, texts = toxicity.labelled(d, lab, "doc_id", "text", "toxic"), toxicity.texts_of(d, "doc_id", "text")
    lists, y = toxicity.fit_sample(rows, texts, 10, 6_000, every)  # all too long: as many as there is room for
    assert 0 < y.sum() < len(y) < 20 and toxicity.fit(d, lab, fit_chars=100)[0].any()


def test_gradient_in_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(0, 400, rng.integers(0, 90))) for _ in range(60)]
    y, ratio = (rng.random(60) < 0.4).astype(float), np.zeros(toxicity.SIZE)
    ratio[:400] = rng.normal(size=400)
    whole = toxicity.weights(lists, y, ratio, np.array([40, 20]))
    monkeypatch.setattr(toxicity, "FIT_ENTRIES", 100)
    parts = toxicity.weights(lists, y, ratio, np.array([40, 20]))
    assert np.allclose(whole[0], parts[0]) and abs(whole[1] - parts[1]) < 1e-9


def test_counts_and_query_equal_plain_ones(spark, tmp_path):
    """Feature counts by class, scores and the query's columns against sets of n-grams counted one by one."""
    from tidemark.llm.queries import op2_toxicity

    docs, labels = made(120, 8)
    docs += [(500, None, None, None, None), (501, "", None, None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    d, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    n, seen = toxicity.class_counts(toxicity.labelled(d, lab, "doc_id", "text", "toxic"))
    learnt = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    texts = {x[0]: x[1] or "" for x in docs}
    grams = lambda t: {t[k : k + m] for m in toxicity.ORDERS for k in range(len(t) - m + 1)}
    number = lambda g: toxicity.features(g.encode(), np.zeros(toxicity.SIZE, bool))
    assert n.tolist() == [sum(v == c for v in learnt.values()) for c in (0, 1)]
    for g in ("moron", "the ", "ou", "ent", "zzq"):
        whole = set(number(g).tolist()) - {f for s in grams(g) - {g} for f in number(s).tolist()}
        for f in whole:
            for c in (0, 1):
                assert seen[c, f] >= sum(g in grams(texts[i].lower()) for i, v in learnt.items() if v == c)
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r for r in op2_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        on = {f for g in grams(t.lower()) for f in number(g).tolist()}
        score = 1 / (1 + np.exp(-(sum(model[0][f] for f in on) + model[1])))
        assert abs(got[i].score - score) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, labels = made(200, 3)
    some = {x[0] for x in docs if (x[0] % 4 or x[0] % 16 == 0 or x[0] < 9) and x[0] not in range(101, 110)}  # toxic ones are rare
    docs, labels = [x for x in docs if x[0] in some], [x for x in labels if x[0] in some]
    rnd = random.Random(9)
    fresh = lambda k: [f"w{rnd.randrange(10**9)}" for _ in range(k)]
    base = fresh(80)
    near = list(base)
    near[40] = "changed"
    item = fresh(14)
    shared = " ".join(fresh(20))
    docs += [
        (101, " ".join(base), "en", "s", 1),
        (102, " ".join(base), "en", "s", 1),
        (103, " ".join(near), "en", "s", 1),
        (104, " ".join(fresh(30) + item + fresh(30)), "en", "s", 1),
        (105, " ".join(fresh(60)) + "\n" + shared, "en", "s", 1),
        (106, " ".join(fresh(60)) + "\n" + shared, "en", "s", 1),
        (107, None, None, None, None),
        (108, "", "", "", 0),
    ]
    big = base[:10] + fresh(1) + base[11:40] + ["\n"] + fresh(4)
    docs.append((109, " ".join(big), "en", "s", 1))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == [c.split()[0] for c in DOCS.split(", ")]
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in step.collect()}
    assert not {0, 4, 8} & set(seen["toxicity"]) and {1, 2, 3, 101, 107, 108} <= set(seen["toxicity"])
    lines = seen["line_dedup"]
    assert {101, 104, 105, 106, 107, 108} <= set(lines) and not {102, 103} & set(lines)
    assert lines[105].text.endswith(shared) and "\n" not in lines[106].text and lines[106].n_chars == len(lines[106].text)
    assert {101, 104, 105, 106, 107, 108} <= set(seen["ngram_jaccard"])
    assert 104 not in seen["decontamination"] and {101, 105, 106, 107, 108} <= set(seen["decontamination"])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(seen["decontamination"]) and got[108].n_tokens == 0 and got[101].n_tokens == len(got[101]["ids"]) > 80


def test_line_dedup_keeps_documents_with_words_left(spark):
    rnd = random.Random(4)
    own = lambda k: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(k))
    mine, license, body, copied = own(50), own(200), own(12), own(30)
    docs = [(1, license, "en", "s", 1), (2, "\n".join([mine] * 5), "en", "s", 1), (3, f"{license}\n{body}", "en", "s", 1), (4, copied, "en", "s", 1), (5, f" \n{copied}\n", "en", "s", 1), (6, " \n", "en", "s", 1), (7, None, None, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, DOCS), "").collect()}
    assert got == {1: (license, len(license)), 2: (mine, len(mine)), 3: (body, len(body)), 4: (copied, len(copied)), 6: (" \n", 2), 7: (None, None)}


def test_pipeline_stages_exchange_small_batches(spark, tmp_path, monkeypatch):
    """No Arrow batch of a stage, in or out, is much larger than BATCH_BYTES; the session keeps its settings."""
    from pyspark import RDD
    from pyspark.sql import SparkSession

    from tidemark.llm import common

    spark.createDataFrame([(i, f"{i} " + f"w{i} of the text\n" * 3000, "en", "s", 1) for i in range(120)], DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"label-{i}", i % 2) for i in range(0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes, frame = f"{tmp_path}/sizes", type(spark.range(0))
    kept = frame.mapInArrow

    def watched(self, fn, schema, *rest):
        def run(batches):
            def note(batch):
                with open(sizes, "a") as f:
                    f.write(f"{batch.nbytes}\n")
                return batch

            yield from map(note, fn(map(note, batches)))

        return kept(self, run, schema, *rest)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    setting, to_df = "spark.sql.execution.arrow.maxBytesPerBatch", RDD.toDF
    before = spark.conf.get(setting)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == "line_dedup":
            continue
        open(sizes, "w").close()
        assert stage(spark, docs, str(tmp_path)).count() > 0
        found = list(map(int, open(sizes)))
        assert sum(found) > 5_000_000 or name == "toxicity" and not found
        assert max(found, default=0) < 1.5 * common.BATCH_BYTES, name
    assert spark.conf.get(setting) == before and SparkSession.getActiveSession().conf.get(setting) == before and RDD.toDF is to_df


def test_batches_in_pieces():
    import pyarrow as pa

    from tidemark.llm.common import in_pieces

    rows = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50 + [None, ""])], ["text"])
    cut = list(in_pieces(rows, 5000))
    assert pa.Table.from_batches(cut).to_pylist() == rows.to_pylist() and max(b.nbytes for b in cut) <= 6000
    assert [b.num_rows for b in in_pieces(rows.slice(0, 0))] == [0] and [b.num_rows for b in in_pieces(rows)] == [52]
