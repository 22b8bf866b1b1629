"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (2 to 5 characters, lower case) that occur in it. Their log-count ratios come from
all labelled training documents, counted in one pass that sums a vector a task before the shuffle. A logistic regression
on the scaled features is then fitted on a bounded sample and its intercept corrected to the share of toxic documents
among all labelled ones. The sample has at most FIT_ROWS distinct texts a class, chosen by a hash of the text, those of up
to FIT_CHARS characters first; longer ones fill it up as long as it has no more than FIT_ROWS * FIT_CHARS characters.
Scoring is a sum of weights, in Arrow batches, with a weight vector of fixed size.

Defined results: null and empty texts have no features and get the intercept's score; texts of any length are counted and
scored whole; labels that are null or belong to no document are ignored; of several labels of one document, or of equal
texts in the sample, the largest holds; with only one class, or none, every document gets the share of toxic labels (0
without labels) as score; equal texts get equal scores, and repeated rows are in the sample once; an empty table gives an
empty one; extra columns, whatever their names, are ignored by `score` and kept as they are by `reject_toxic`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import encoded, give_back, mixed, require, sliced, small, unused, with_computed, worker_state

ORDERS = (2, 3, 4, 5)
BITS = 18
SIZE = 1 << BITS
BLOCK = 1 << 12
#: Bounds of the sample that the weights are fitted on, and the score of a rejection.
FIT_ROWS, FIT_CHARS = 1500, 20_000
THRESHOLD = 0.3
#: Entries of the sample that a gradient step looks at together.
FIT_ENTRIES = 1 << 20


def held_out(id_col: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The sorted feature numbers of a text; seen is a zeroed array of flags, left zeroed."""
    codes = np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = codes
    marks = []
    with np.errstate(over="ignore"):
        for n in range(2, ORDERS[-1] + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            at = (mixed(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            seen[at] = True
            marks.append(at)
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def flags() -> np.ndarray:
    return worker_state("toxicity").setdefault("toxicity_flags", np.zeros(SIZE, bool))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, _text, its hash _h and length _n, _label) of the labelled documents outside the held-out part. Labels are
    broadcast only while there are few."""
    one = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    one = one.where(~held_out(F.col("_id")))
    few = small(one, *(["_id"] if one.schema["_id"].dataType.simpleString() in ("string", "binary") else []))
    return texts_of(docs, id_col, text_col).join(F.broadcast(one) if few else one, "_id")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hash and length are taken before any join, so that a pass over them moves no text."""
    texts = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    return texts.withColumns({"_h": F.xxhash64("_text"), "_n": F.length("_text")})


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each class the number of documents, and of those with each feature."""

    def count(batches):
        seen = flags()
        totals = np.zeros((2, SIZE), np.int64)
        n = np.zeros(2, np.int64)
        for batch in sliced(batches):
            for text, label in zip(encoded(batch.column(0)), batch.column(1).to_pylist()):
                totals[label, features(text, seen)] += 1
                n[label] += 1
        give_back()
        if n.any():
            blocks = [(label, b, totals[label, b * BLOCK : (b + 1) * BLOCK].tobytes()) for label in (0, 1) if n[label] for b in range(SIZE // BLOCK)]
            blocks += [(label, -1, n[label : label + 1].tobytes()) for label in (0, 1) if n[label]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.binary()))], ["label", "block", "counts"])

    def add(key, part):
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in part.column("counts"))
        return pa.table({"label": [key[0].as_py()], "block": [key[1].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("label", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())]))

    shape = "label int, block int, counts binary"
    sums = rows.select("_text", "_label").mapInArrow(count, shape).groupBy("label", "block").applyInArrow(add, shape)
    docs, seen = np.zeros(2, np.int64), np.zeros((2, SIZE), np.int64)
    for r in sums.collect():  # at most 2 * (SIZE / BLOCK + 1) rows, whatever the input
        got = np.frombuffer(r.counts, np.int64)
        if r.block < 0:
            docs[r.label] = got[0]
        else:
            seen[r.label, r.block * BLOCK : (r.block + 1) * BLOCK] = got
    return docs, seen


def fit_sample(rows: DataFrame, texts: DataFrame, fit_rows: int, fit_chars: int, useful: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The useful features (an array of flags) and labels of at most fit_rows distinct texts a class."""
    distinct = rows.groupBy("_h").agg(F.min("_id").alias("_id"), F.max("_label").alias("_label"), F.min("_n").alias("_n"))
    chosen: list[tuple] = []
    for label in (0, 1):
        room = fit_rows * fit_chars
        ranked = distinct.where(F.col("_label") == label).orderBy(F.col("_n") > fit_chars, "_h", "_id").limit(fit_rows)
        for k, r in enumerate(ranked.collect()):  # fit_rows rows at most, without texts
            room -= r["_n"]
            if k and room < 0:
                break
            chosen.append((r["_id"], r["_h"], label))
    ids = rows.schema["_id"].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame(chosen, f"_id {ids}, _h long, _label int")
    sample = texts.join(F.broadcast(wanted), ["_id", "_h"]).select("_text", "_h", "_label")
    shipped = rows.sparkSession.sparkContext.broadcast(useful)

    def listed(batches):
        seen, useful = flags(), shipped.value
        done: set[int] = set()
        for batch in sliced(batches):
            keep = [k for k, h in enumerate(batch.column(1).to_pylist()) if not (h in done or done.add(h))]  # repeated rows once a task
            batch = batch.take(pa.array(keep, pa.int64()))
            found = (features(t, seen) for t in encoded(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[useful[f]].astype(np.int32).tobytes() for f in found], pa.binary()), batch.column(2)], ["h", "f", "label"])

    got = sample.mapInArrow(listed, "h long, f binary, label int").groupBy("h").agg(F.min("f").alias("f"), F.max("label").alias("label"))
    got = got.orderBy("h").toArrow()  # a row a chosen text, at most 2 * fit_rows
    return [np.frombuffer(f.as_py(), np.int32) for f in got.column("f")], got.column("label").to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> tuple[np.ndarray, float]:
    """Weights (one a feature, of fixed size) and intercept."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    rows = labelled(docs, labels, id_col, text_col, label_col)
    n, seen = class_counts(rows)
    if not n.all():
        share = n[1] / max(1, n.sum())
        return np.zeros(SIZE), math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    rate = (seen + 1.0) / (seen.sum(axis=1, keepdims=True) + 1.0 * SIZE)
    ratio = np.log(rate[1] / rate[0])
    ratio[(seen.sum(axis=0) < 3) | (np.abs(ratio) < 0.7)] = 0
    lists, y = fit_sample(rows, texts_of(docs, id_col, text_col), fit_rows, fit_chars, ratio != 0)
    if not 0 < y.sum() < len(y):  # equal texts labelled both ways can leave the sample without a class
        return np.zeros(SIZE), math.log(n[1] / n[0])
    got = weights(lists, y, ratio, n)
    del lists
    give_back()
    return got


def weights(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, n: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by accelerated gradient steps, some texts at a time."""
    sizes = np.array([len(f) for f in lists])
    used, flat = np.unique(np.concatenate(lists), return_inverse=True)
    flat, scale = flat.astype(np.int32), ratio[used]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    groups = np.flatnonzero(np.diff(begins // FIT_ENTRIES, prepend=-1)).tolist()  # first texts of groups of about FIT_ENTRIES
    parts = list(zip(groups, [*groups[1:], len(lists)]))

    def each(part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        a, b = part
        return flat[begins[a] : ends[b - 1]], np.repeat(np.arange(b - a), sizes[a:b])

    square = sum(float((scale[each(p)[0]] ** 2).sum()) for p in parts) / len(lists)
    step = 4.0 / (square * 2 + 1)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh alike
    w, b = np.zeros(len(used)), 0.0
    v, c = w.copy(), b
    for t in range(steps):
        scaled, gradient, errors = v * scale, ridge * v, 0.0
        for p in parts:
            at, owner = each(p)
            z = np.bincount(owner, scaled[at], minlength=p[1] - p[0]) + c
            error = weight[p[0] : p[1]] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[p[0] : p[1]])
            gradient += np.bincount(at, error[owner], minlength=len(used)) * scale
            errors += float(error.sum())
        nw, nb = v - step * gradient, c - step * errors
        momentum = t / (t + 3)
        v, c = nw + momentum * (nw - w), nb + momentum * (nb - b)
        w, b = nw, nb
    out = np.zeros(SIZE)
    out[used] = w * scale
    return out, b + math.log(n[1] / n[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """(id, kept columns, score) of every document; `name` is the score's. A kept column of that name is left out."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def fn(pairs):
        w, b = shipped.value
        seen = flags()
        for rows, texts in pairs:
            z = np.array([w[features(t, seen)].sum() + b for t in encoded(texts)], float)
            yield rows, [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())]

    return with_computed(docs, text_col, [id_col, *(c for c in keep if c != id_col)], fn, f"{name} double")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    name = unused(docs.columns, "score")
    rows = score(docs, fit(docs, labels, id_col, text_col, **options), id_col, text_col, keep=tuple(docs.columns), name=name)
    return rows.where(F.col(name) < threshold).select(*docs.columns)
