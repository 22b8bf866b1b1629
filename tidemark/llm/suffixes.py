"""Benchmark decontamination with suffix arrays over shards of the training words.

Each task builds suffix arrays over shards of whole documents (SHARD_BYTES of text, then the shard is searched and
let go), sorted by prefix doubling. Every suffix of every benchmark item is binary-searched in each shard; its neighbours in
the sorted order give its longest verbatim match and where it lies. An item window whose suffix matches over its full
length occurs; the range of suffixes that begin with it gives all its places. Nothing is shuffled.

Only words that the benchmark has can match, so a shard's array holds just the suffixes within runs of such words that
are long enough for the shortest window; this loses no match.

The benchmark is numbered once on the driver and broadcast as arrays, in blocks of at most BLOCK_BYTES of text. Of a larger
benchmark a task holds one block at a time, searches its shard for it and adds the hits to those found before. An item that is longer than a block is cut
into runs of words that overlap by a window less one word, so that each of its windows is in one of them.

Defined results: null and empty texts have no words and no hits; texts of any length are searched whole; items without
words have no window; an item of fewer words than a window is one window; items that share an id count once; a null id
counts as "null"; repeated documents are judged alike; an empty benchmark leaves all documents clean; an empty table gives
an empty one. `mark` leaves out kept columns that are named like its own, `decontaminate` keeps all columns as they are.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, require, sliced, unused, with_computed

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

#: Bytes of a word: digits, a-z and all of other scripts; A-Z count as a-z, the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class TestSuffixes:
    """All suffixes of a block of benchmark items, as numbers of the block's vocabulary (0: not in it)."""

    def __init__(self, items: list[tuple[str, int, bytes]], window: int):
        self.names = sorted({name for name, _, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        starts, lengths, owners, sizes, places = [], [], [], [], []
        for name, first, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids)):
                starts.append(len(flat) + k)
                lengths.append(len(ids) - k)
                owners.append(at[name])
                places.append(first + k)
                sizes.append(size if len(ids) - k >= size else 0)  # 0: too near to the end for a window
            flat += ids
        self.flat = np.array([*flat, 0], np.int32)
        self.starts, self.lengths, self.owners, self.sizes = (np.array(x, np.int32) for x in (starts, lengths, owners, sizes))
        self.item_words = np.array(places, np.int32)  # where in its item a suffix begins
        self.shortest = int(self.sizes[self.sizes > 0].min()) if len(starts) else 0
        self.longest = int(self.lengths.max()) if len(starts) else 0


class Shard:
    """The suffix array of one shard of training words."""

    def __init__(self, ids: np.ndarray, shortest: int, depth: int):
        inside = ids > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        first, last = edges[::2], edges[1::2]
        long = last - first >= shortest
        first, last = first[long], last[long]
        sizes = last - first
        total = int(sizes.sum())
        base = np.cumsum(sizes) - sizes
        self.places = np.arange(total) + np.repeat(first - base, sizes)  # of the suffixes, in the shard
        self.left = np.repeat(last, sizes) - self.places  # words until the run ends
        self.ids = ids
        rank, k = ids[self.places].astype(np.int64), 1
        while k < depth and total:
            nxt = np.zeros(total, np.int64)
            has = np.flatnonzero(self.left > k)
            nxt[has] = rank[has + k]
            values, rank = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            k *= 2
            if len(values) == total:
                break
        self.order = np.argsort(rank, kind="stable")

    def compare(self, at: np.ndarray, test: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For suffix at[i] of the sorted order and the i-th test string: -1, 0 or 1 as the suffix, cut to the string's
        length, is less, equal or greater; and how many words they share."""
        which = self.order[at]
        place, limit = self.places[which], np.minimum(self.left[which], lengths)
        shared = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            live = live[shared[live] < limit[live]]
            live = live[self.ids[place[live] + shared[live]] == test[starts[live] + shared[live]]]
            shared[live] += 1
        sign = np.zeros(len(at), np.int64)
        short = (shared == limit) & (limit < lengths)
        sign[short] = -1
        differs = np.flatnonzero(shared < limit)
        sign[differs] = np.sign(self.ids[place[differs] + shared[differs]].astype(np.int64) - test[starts[differs] + shared[differs]])
        return sign, shared

    def bound(self, test: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search: the first suffix not less than each test string, or with upper the first greater."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) // 2
            sign, _ = self.compare(mid, test, starts[live], lengths[live])
            right = sign < 0 if not upper else sign <= 0
            lo[live[right]], hi[live[~right]] = mid[right] + 1, mid[~right]

    def longest(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix its longest verbatim match in words, and one place of it in the shard."""
        n = len(tests.starts)
        best, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if not len(self.order):
            return best, place
        low = self.bound(tests.flat, tests.starts, tests.lengths, upper=False)
        for near in (low - 1, low):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            _, shared = self.compare(near[ok], tests.flat, tests.starts[ok], tests.lengths[ok])
            better = shared > best[ok]
            best[ok[better]] = shared[better]
            place[ok[better]] = self.places[self.order[near[ok[better]]]]
        return best, place


def search(docs: list[bytes], tests: TestSuffixes) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]], list[tuple[int, int, int, int]]]:
    """For each document its number of words, merged spans of hit words and the names of the items that occur; and for
    the shard (test suffix, words, document, word) of the longest matches that reach a window."""
    get = tests.vocabulary.get
    numbers = []
    for t in docs:  # the words of one document at a time
        words = words_of(t)
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
    counts = np.array([len(x) for x in numbers], np.int64)
    ids = np.zeros(int(counts.sum()) + len(docs) + 1, np.int64)
    ends = np.cumsum(counts + 1)
    begins = ends - counts - 1
    for b, x in zip(begins, numbers):
        ids[b : b + len(x)] = x
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    names: list[list[str]] = [[] for _ in docs]
    matches: list[tuple[int, int, int, int]] = []
    if tests.shortest:
        shard = Shard(ids, tests.shortest, tests.longest)
        best, place = shard.longest(tests)
        hit = np.flatnonzero((tests.sizes > 0) & (best >= tests.sizes))
        if len(hit):
            owner_doc = np.searchsorted(ends, place[hit], side="right")
            matches = [(int(s), int(best[s]), int(d), int(place[s] - begins[d])) for s, d in zip(hit, owner_doc)]
            low = shard.bound(tests.flat, tests.starts[hit], tests.sizes[hit], upper=False)
            high = shard.bound(tests.flat, tests.starts[hit], tests.sizes[hit], upper=True)
            many = high - low
            which = np.repeat(np.arange(len(hit)), many)
            places = shard.places[shard.order[np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)]]
            cover = np.zeros(len(ids) + 1, np.int64)
            np.add.at(cover, places, 1)
            np.add.at(cover, places + tests.sizes[hit][which], -1)
            covered = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]))
            edges = np.flatnonzero(np.diff(covered))
            for a, b in zip(edges[::2], edges[1::2]):
                d = int(np.searchsorted(ends, a, side="right"))
                spans[d].append((int(a - begins[d]), int(b - begins[d])))
            doc = np.searchsorted(ends, places, side="right")
            for key in np.unique(doc * len(tests.names) + tests.owners[hit][which]):
                names[int(key) // len(tests.names)].append(tests.names[int(key) % len(tests.names)])
    return counts.tolist(), spans, names, matches


def joined(old: list, new: list) -> list:
    """Union of two lists of (start, end) spans."""
    out: list = []
    for a, b in sorted([*map(tuple, old), *map(tuple, new)]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(name: str, text: bytes, block_bytes: int, window: int) -> list[tuple[str, int, bytes]]:
    """The item and 0, or where it is longer than a block its words in overlapping runs of about half a block, and at
    which of its words each begins."""
    if len(text) <= block_bytes:
        return [(name, 0, text)]
    words, out, a = words_of(text), [], 0
    ends = np.cumsum([len(w) + 1 for w in words])
    while a < len(words):
        b = max(a + window, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + block_bytes // 2, side="right")))
        if len(words) - b < window:
            b = len(words)
        out.append((name, a, b" ".join(words[a:b])))
        a = len(words) if b == len(words) else b - window + 1
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int):
    """How many blocks the benchmark makes, and a function from a block's number to its items. The driver holds one block
    at a time, of not much more than block_bytes."""
    rows = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("null")).alias("id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))
    if (rows.agg(F.max(F.octet_length("text"))).first()[0] or 0) > block_bytes:

        def cut(batches):
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                    for run in runs_of(name, text, block_bytes, window):
                        yield pa.RecordBatch.from_arrays([pa.array([run[0]]), pa.array([run[1]]), pa.array([run[2].decode()])], ["id", "first", "text"])

        rows = rows.mapInArrow(cut, "id string, first long, text string")
    else:
        rows = rows.select("id", F.lit(0).cast("long").alias("first"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1

    def block(k: int) -> list[tuple[str, int, bytes]]:
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        return [(r.id, r["first"], r.text.encode()) for r in part.collect()]

    return n, block


#: Names of what `mark` computes, and their types.
MARKS = {"n_words": "long", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = tuple(MARKS)) -> DataFrame:
    """(id, kept columns, n_words, spans array<struct<start,end>> of hit words, items array<string> sorted); names are those
    of the last three."""
    require(docs, id_col, text_col, *keep)
    require(benchmark, item_id, item_text)
    spark = docs.sparkSession
    n, block = blocks_of(benchmark, item_id, item_text, block_bytes, window)
    shipped = [spark.sparkContext.broadcast(TestSuffixes(block(k), window)) for k in range(n)]
    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, MARKS.values()))

    def fn(pairs):
        for whole, texts in shards_of(pairs):
            counts, spans, items = [], None, None
            for tests in held(shipped):
                counts, more, found, _ = search(texts, tests)
                spans = more if spans is None else [joined(a, b) for a, b in zip(spans, more)]
                items = found if items is None else [sorted({*a, *b}) for a, b in zip(items, found)]
            marks = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield whole, [pa.array(counts, pa.int64()), marks, pa.array(items, pa.list_(pa.string()))]

    return with_computed(docs, text_col, [id_col, *(c for c in keep if c != id_col)], fn, schema)


def held(shipped: list):
    """The values of broadcasts one by one, of which a task keeps only the last in memory."""
    for b in shipped:
        yield b.value
        if len(shipped) > 1:
            b.__dict__.pop("_value", None)


def shards_of(pairs):
    """(rows' arrays, texts) of whole documents, SHARD_BYTES at a time."""
    rows, texts, size = [], [], 0
    for r, column in pairs:
        new = list(encoded(column))
        rows.append(r)
        texts += new
        size += sum(map(len, new))
        if size >= SHARD_BYTES:
            yield [pa.concat_arrays([x[i] for x in rows]) for i in range(len(r))], texts
            rows, texts, size = [], [], 0
    if texts:
        yield [pa.concat_arrays([x[i] for x in rows]) for i in range(len(rows[0]))], texts


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, item_word, n_words, id, word): for every benchmark suffix that occurs over a window or more (for shorter items,
    over the whole item) its longest verbatim match in all documents, and the first place of those that are so long. Each
    shard gives its longest; a task of the aggregate holds a row a suffix, never documents."""
    require(docs, id_col, text_col)
    require(benchmark, item_id, item_text)
    n, block = blocks_of(benchmark, item_id, item_text, block_bytes, window)
    texts = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].alias("id"))
    shipped = [docs.sparkSession.sparkContext.broadcast(TestSuffixes(block(k), window)) for k in range(n)]

    def find(batches):
        for (ids,), shard in shards_of(([b.column(1)], b.column(0)) for b in sliced(batches)):
            for tests in held(shipped):
                found = search(shard, tests)[3]
                s, words, d, place = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
                names = pa.array([tests.names[o] for o in tests.owners[s]], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(tests.item_words[s].astype(np.int64)), pa.array(words), ids.take(pa.array(d)), pa.array(place)], ["item", "item_word", "n_words", "id", "word"])

    every = texts.mapInArrow(find, f"item string, item_word long, n_words long, id {texts.schema['id'].dataType.simpleString()}, word long")
    best = every.groupBy("item", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("back"), "id", "word")).alias("x"))
    return best.select("item", "item_word", (-F.col("x.back")).alias("n_words"), F.col("x.id").alias(id_col if id_col.lower() not in ("item", "item_word", "n_words", "word") else "id"), F.col("x.word").alias("word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, in which no window of the benchmark occurs."""
    names = tuple(unused(docs.columns, name) for name in MARKS)
    marked = mark(docs, benchmark, id_col, text_col, keep=tuple(docs.columns), names=names, **options)
    return marked.where(F.size(names[1]) == 0).select(*docs.columns)
