"""N-gram Jaccard join: connected groups of documents whose sets of word shingles overlap.

Documents with equal sets form one class, known by a digest of 128 bits; only classes are searched. The search for candidates
carries 64 of these bits; classes that share them are searched as one and then compared apart.

Finding candidates is a T-occurrence problem in two steps. All shingles have one global order, rarest first: shingles
that are frequent within some shard of the corpus come last, by their counts, the others go by hash. Two classes that
link share at least `c` of the first `p + c - 1` shingles in that order (p = n - T + 1, T the overlap that n shingles
need). These prefixes are inverted. A class with fewer than c prefix shingles that any other class has can't link and is
let go, which ends the search for nearly all documents. Of the others' shared prefix shingles the longest c - 1 lists are
skipped, as in DivideSkip; classes that meet in a remaining, short list go to the block of that list's smallest class. There
only classes that share enough prefix shingles with one and the same other class stay (blocks over BLOCK_BYTES keep all).

Each block holds the whole sets of its classes and solves the T-occurrence problem exactly: for each class the short
lists are merged, the L longest are binary-probed for the candidates, and those that reach the required overlap link.
Classes already connected aren't compared again, so a block of many near copies yields a spanning forest, not all pairs.

Blocks over BLOCK_BYTES are dealt into parts, each with some seeds, classes that all parts hold. What a part links is found
first. Nearly always the seeds then connect the block's large group across its parts, and only the classes outside it have
still to meet the other parts, so these alone are copied to them. Lists are inverted by buckets of shingles; a bucket with more
than FAT_POSTINGS entries, as a shingle that very many classes share makes it, is counted by rows instead of in one task.
Components of the links come from min-label propagation with pointer jumping.

Defined results: null texts and texts without words have no shingles and link with nothing (component: their own id);
texts of fewer words than a shingle are one shingle; texts of any length are taken whole; a null id takes part through its
text, and a group of null ids only has a null component; rows that share an id are each judged by their text; extra
columns, whatever their names, are ignored by `grouped` and kept by `keep_one`; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chained, cut, encoded, give_back, mixed, require, sliced, small, word_hashes

#: Text in a shard; a shingle is frequent if so many of a shard's distinct sets have it; how many frequent ones are shipped.
SHARD_BYTES, FREQUENT, SHIPPED_FREQUENT = 4 << 20, 12, 2_000_000
#: Postings in a bucket of the inverted prefixes, and from how many on it is fat; bytes of a block; seeds of a large one.
BUCKET_POSTINGS, FAT_POSTINGS, BLOCK_BYTES, SEEDS = 300_000, 2_000_000, 32 << 20, 32


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(chained(word_hashes().of(words), min(size, len(words))))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, as two signed numbers; the search carries the first."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed=len(tokens))
    return tuple(n - (1 << 64) if n >> 63 else n for n in (x & 0xFFFFFFFFFFFFFFFF, x >> 64))


def overlap(n: int, num: int, den: int) -> int:
    """The overlap that a set of n needs with any set no larger."""
    return -(-n * num // den)


def shared_least(n: int, num: int, den: int) -> int:
    """c: how many prefix shingles sets of this size share at least, if they link with one no smaller."""
    return max(1, (n - overlap(n, num, den) + 1) // 2)


def prefix_size(n: int, num: int, den: int) -> int:
    return min(n, n - overlap(n, num, den) + shared_least(n, num, den))


def shards_of(batches, size: int):
    """Lists of (row arrays, set) of whole documents, shard by shard. A caller lets go of a shard before it asks for the next,
    so that a worker holds one at a time."""
    rows, got, held = [], [], 0
    for batch in sliced(batches, limit=SHARD_BYTES):
        for text in encoded(batch.column(0)):
            got.append(shingles(text, size))
            held += len(text)
        rows.append(batch.columns[1:])
        if held >= SHARD_BYTES:
            yield rows, got
            rows, got, held = [], [], 0
            give_back()
    if got:
        yield rows, got
        give_back()


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles (sorted) with their ranks by count, and how many shingles all sets have. Only the lower half of
    the hash range is counted, as prefixes hardly reach beyond; any global order is a right one."""
    half = np.uint64(1 << 63)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        seen, own = set(), []
        for s in sets:
            if len(s) and (d := digest(s)) not in seen:
                seen.add(d)
                own.append(s[: np.searchsorted(s, half)])
        tokens, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = counts >= FREQUENT
        total = sum(map(len, sets))
        return pa.RecordBatch.from_arrays([pa.array([None, *tokens[often].view(np.int64)], pa.int64()), pa.array([total, *counts[often]], pa.int64())], ["token", "n"])

    def count(batches):
        for rows, sets in shards_of(batches, size):
            yield counted(sets)
            del rows, sets

    sums = cut(docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = sums.where("token IS NULL").agg(F.sum("n")).first()[0] or 0
    listed, least = sums.where("token IS NOT NULL"), FREQUENT
    while listed.count() > SHIPPED_FREQUENT:
        least *= 2
        listed = listed.where(F.col("n") >= least)
    got = listed.select("token", "n").toArrow()
    tokens, counts = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(1, len(tokens) + 1)
    order = np.argsort(tokens)
    return tokens[order], rank[order], total


def prefix(tokens: np.ndarray, n: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n of a set's tokens in the global order."""
    if not len(frequent):
        return tokens[:n]
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    known = frequent[at] == tokens
    plain = tokens[~known]
    if len(plain) >= n:
        return plain[:n]
    rest = tokens[known]
    return np.concatenate((plain, rest[np.argsort(rank[at[known]], kind="stable")][: n - len(plain)]))


def inverted(docs: DataFrame, size: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, t, n, v, u) of each document, (v, u) its class; and the prefix shingles that several classes have, as (v, need,
    df, token). docs: text, id, t."""
    frequent, rank, total = frequent_shingles(docs, size)
    shipped = docs.sparkSession.sparkContext.broadcast((frequent, rank))
    buckets = max(8, int(total * (1 - num / den) * 1.5) // BUCKET_POSTINGS)
    id_type = docs.schema["id"].dataType.simpleString()

    def of_documents(rows: list, sets: list[np.ndarray], keys: list[tuple[int, int]]) -> pa.RecordBatch:
        ids, texts = (pa.concat_arrays([r[i] for r in rows]) for i in (0, 1))
        sizes = np.array([len(s) for s in sets], np.int64)
        v, u = (pa.array(np.array(x, np.int64), mask=sizes == 0) for x in zip(*keys))
        none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.int32(), pa.binary())]
        return pa.RecordBatch.from_arrays([ids, texts, pa.array(sizes), v, u, *none], names)

    def of_buckets(sets: list[np.ndarray], v: list[int], id_type: pa.DataType, frequent: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        parts = [prefix(s, prefix_size(len(s), num, den), frequent, rank) for s in sets]
        lengths = [len(p) for p in parts]
        tokens = np.concatenate(parts)
        need = np.repeat(np.array([shared_least(overlap(len(s), num, den), num, den) for s in sets], np.int32), lengths)
        bucket = (mixed(tokens) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        filled, cuts = np.unique(bucket[order], return_index=True)  # those that this shard has, however many there are
        cuts = [*cuts.tolist(), len(order)]
        data, need = np.stack((tokens.view(np.int64), np.repeat(np.array(v, np.int64), lengths)), axis=1)[order], need[order]
        blobs = [data[a:b].tobytes() + need[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        nulls = [pa.nulls(len(filled), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array(filled, pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(blobs, pa.binary())], names)

    def invert(batches):
        seen: set[tuple[int, int]] = set()  # a task writes the postings of a class once
        for rows, sets in shards_of(batches, size):
            keys = [digest(s) if len(s) else (0, 0) for s in sets]
            yield of_documents(rows, sets, keys)
            firsts = [k for k, key in enumerate(keys) if len(sets[k]) and not (key in seen or seen.add(key))]
            if firsts:
                yield of_buckets([sets[k] for k in firsts], [keys[k][0] for k in firsts], rows[0][0].type, *shipped.value)
            del rows, sets, keys, firsts

    names = ["id", "t", "n", "v", "u", "bucket", "k", "blob"]
    both = scratch.keep("prefixes", docs.mapInArrow(invert, f"id {id_type}, t long, n long, v long, u long, bucket int, k int, blob binary"))

    def unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        k = len(x) // 20
        return np.frombuffer(x, np.int64, 2 * k).reshape(k, 2), np.frombuffer(x, np.int32, k, 16 * k)

    def meet(key, part):
        pairs, needs = (np.concatenate(x) for x in zip(*map(unpacked, part.column("blob").to_pylist())))
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, needs = pairs[order], needs[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)  # copies of a class in other tasks
        needs, pairs = np.minimum.reduceat(needs, np.flatnonzero(new)), pairs[new]
        starts = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0])))
        lengths = np.diff(np.append(starts, len(pairs)))
        df = np.repeat(lengths, lengths)
        keep = df > 1
        made = pa.table({"v": pairs[keep, 1], "need": needs[keep], "df": df[keep], "token": pairs[keep, 0]})
        del pairs, needs, order, new, df, keep, part
        give_back()
        return made

    def rows_of(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                pairs, needs = unpacked(x)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(needs)], ["token", "v", "need"])

    light = both.where("bucket IS NULL").select("id", "t", "n", "v", "u")
    lists = both.where("bucket IS NOT NULL").select("bucket", "blob")
    fat = cut(both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("k").alias("k")).where(F.col("k") > FAT_POSTINGS).select("bucket"))
    if fat.isEmpty():
        return light, lists.groupBy("bucket").applyInArrow(meet, "v long, need int, df long, token long")
    listed = F.broadcast(fat) if small(fat) else fat
    thin = lists.join(listed, "bucket", "left_anti").groupBy("bucket").applyInArrow(meet, "v long, need int, df long, token long")
    single = lists.join(listed, "bucket", "left_semi").select("blob").mapInArrow(rows_of, "token long, v long, need int")
    single = cut(single.groupBy("token", "v").agg(F.min("need").alias("need")))
    counts = cut(single.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    many = single.join(F.broadcast(counts) if small(counts) else counts, "token").select("v", "need", "df", "token")
    return light, thin.unionByName(many)


def blocks(postings: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distinct (hub, v): the classes of each block that share enough prefix shingles with another one in it."""
    of_class = postings.groupBy("v").agg(F.min("need").alias("need"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("lists"))
    of_class = cut(of_class.where(F.size("lists") >= F.col("need")).select("v", "need", F.transform("lists", lambda x: x["token"]).alias("tokens")))
    short = cut(of_class.select("v", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1)).alias("token")))
    hubs = short.groupBy("token").agg(F.min("v").alias("hub"), F.max("v").alias("last")).where("hub < last").select("token", "hub")
    members = cut(short.join(hubs, "token").select("hub", "v").distinct())
    large = members.join(of_class.select("v", F.size("tokens").alias("k")), "v").groupBy("hub").agg(F.sum("k").alias("k"))
    large = cut(large.where(8 * F.col("k") > block_bytes).select("hub"))

    def plausible(batches):
        key, values, needs, sets = None, [], [], []
        made: list[tuple[int, int]] = []

        def out():
            return [(key, values[k]) for k in sharing(sets, np.array(needs, np.int64))]

        for batch in batches:
            flat, offsets = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k, (hub, v, need) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if hub != key:
                    if key is not None:
                        made += out()
                    key, values, needs, sets = hub, [], [], []
                values.append(v)
                needs.append(need)
                sets.append(flat[offsets[k] : offsets[k + 1]])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], ["hub", "v"])
                made = []
        if key is not None:
            made += out()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], ["hub", "v"])

    rest, whole = members, None
    if not large.isEmpty():  # blocks that no single task should look at: all their classes stay
        listed = F.broadcast(large) if small(large) else large
        rest, whole = members.join(listed, "hub", "left_anti"), members.join(listed, "hub", "left_semi")
    with_tokens = rest.join(of_class, "v").select("hub", "v", "need", "tokens").repartition("hub").sortWithinPartitions("hub", "v")
    found = with_tokens.mapInArrow(plausible, "hub long, v long")
    return cut(found if whole is None else found.unionByName(whole.select("hub", "v")))


def sharing(sets: list[np.ndarray], needs: np.ndarray) -> np.ndarray:
    """Positions of the sets that have as many tokens in common with another set as both need. A set found as another's
    partner isn't searched again, so a block of near copies takes one search."""
    marked = np.zeros(len(sets), bool)
    if len(sets) < 2:
        return np.flatnonzero(marked)
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(token, kind="stable")
    lists = np.repeat(np.arange(len(sets)), sizes)[by]
    starts = np.searchsorted(token[by], np.arange(int(token.max()) + 2))
    begins = np.cumsum(sizes) - sizes
    for q in range(len(sets)):
        if marked[q]:
            continue
        mine = token[begins[q] : begins[q] + sizes[q]]
        lo, counts = starts[mine], starts[mine + 1] - starts[mine]
        met = lists[np.arange(int(counts.sum())) + np.repeat(lo - (np.cumsum(counts) - counts), counts)]
        found, shared = np.unique(met, return_counts=True)
        found = found[(shared >= np.maximum(needs[q], needs[found])) & (found != q)]
        if len(found):
            marked[found] = marked[q] = True
    return np.flatnonzero(marked)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def tops(self, xs: np.ndarray) -> np.ndarray:
        got = self.up[xs]
        while (more := self.up[got] != got).any():
            got = np.where(more, self.up[got], got)
        self.up[xs] = got
        return got


def links_within(sets: list[np.ndarray], sides: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with sides only those between sets of different sides count."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    flat = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")  # postings of a token in order of size
    lists = owner[by]
    starts = np.searchsorted(token[by], np.arange(int(token.max()) + 2))
    begins = np.cumsum(sizes) - sizes
    forest, out = Forest(len(order)), []
    side = None if sides is None else sides[order]
    first = 0
    for q in range(1, len(order)):
        n = int(sizes[q])
        while den * int(sizes[first]) < num * n:
            first += 1
        if first >= q:
            continue
        t = overlap(n, num, den)
        mine = token[begins[q] : begins[q] + n]
        lo, hi = starts[mine], starts[mine + 1]
        rank = np.argsort(hi - lo, kind="stable")
        longest = int((hi - lo)[rank[-1]])
        skipped = max(0, min(t - 1, int(t / (0.02 * np.log2(longest + 1) + 1)))) if longest > 4 else 0  # DivideSkip's L
        short, long = rank[: n - skipped], rank[n - skipped :]
        counts = hi[short] - lo[short]
        places = np.arange(int(counts.sum())) + np.repeat(lo[short] - (np.cumsum(counts) - counts), counts)
        met = lists[places]
        met = met[(met >= first) & (met < q)]
        found, shared = np.unique(met, return_counts=True)  # the merge of the short lists
        ok = shared >= t - skipped
        if side is not None:
            ok &= side[found] != side[q]
        found, shared = found[ok], shared[ok]
        by_count = np.argsort(-shared, kind="stable")
        found, shared = found[by_count], shared[by_count]
        step = 16
        while len(found):
            apart = forest.tops(found) != forest.top(q)
            found, shared = found[apart], shared[apart]
            now, have = found[:step], shared[:step].copy()
            found, shared, step = found[step:], shared[step:], step * 4
            for k in long:  # binary probes of the long lists
                part = lists[lo[k] : hi[k]]
                at = np.searchsorted(part, now)
                have += (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == now)
            for y in now[den * have >= num * (n + sizes[now] - have)]:
                a, b = forest.top(int(y)), forest.top(q)
                if a != b:
                    forest.up[max(a, b)] = min(a, b)
                    out.append((order[q], order[int(y)]))
    return out


def split_blocks(sized: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(hub, parts, classes) of the blocks that are too large for one task. sized: (hub, size) of their classes."""
    sums = sized.groupBy("hub").agg(F.ceil(F.sum("size") / block_bytes).cast("int").alias("parts"), F.count(F.lit(1)).alias("classes"))
    return cut(sums.where("parts > 1"))


def found_links(met: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, a, b), a spanning forest of the links within each group (hub, part, chunk) of met, whose other columns are v, u,
    visits and tokens. Classes that visit link with those that don't; without visitors all link with all."""

    def search(batches):
        key, values, visits, sets = None, [], [], []

        def out():
            mixed_sides = any(visits)
            if len(sets) < 2 or all(visits):
                return []
            found = links_within(sets, np.array(visits, np.int8) if mixed_sides else None, num, den)
            return [(key[0], name(values[x]), name(values[y])) for x, y in found]

        def name(c: tuple[int, int]) -> str:
            return "%016X%016X" % (c[0] & 0xFFFFFFFFFFFFFFFF, c[1] & 0xFFFFFFFFFFFFFFFF)

        made: list[tuple[int, str, str]] = []
        for batch in batches:
            for hub, part, chunk, v, u, visit, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, part, chunk) != key:
                    if key is not None:
                        made += out()
                    key, values, visits, sets = (hub, part, chunk), [], [], []
                if values and values[-1] == (v, u):
                    continue  # repeated rows, or a seed in its own part
                values.append((v, u))
                visits.append(visit)
                sets.append(np.frombuffer(tokens, np.uint64))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.string(), pa.string()))], ["hub", "a", "b"])
                made = []
        if key is not None:
            made += out()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.string(), pa.string()))], ["hub", "a", "b"])
        give_back()

    keys = ["hub", "part", "chunk"]
    dealt = met.select(*keys, "v", "u", "visits", "tokens").repartition(*keys).sortWithinPartitions(*keys, "v", "u")
    return cut(dealt.mapInArrow(search, "hub long, a string, b string"))


def class_name(v: str = "v", u: str = "u"):
    return F.concat(F.lpad(F.hex(v), 16, "0"), F.lpad(F.hex(u), 16, "0"))


def links(met: DataFrame, parts: DataFrame, num: int, den: int, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verified links (a, b) of class names that connect whatever links in any block. met: (hub, v, u, tokens)."""
    alone = {"part": F.lit(0), "chunk": F.lit(0), "visits": F.lit(0)}
    if parts.isEmpty():
        return cut(found_links(met.withColumns(alone), num, den).select("a", "b").distinct())
    listed = F.broadcast(parts) if small(parts) else parts
    one = found_links(met.join(listed, "hub", "left_anti").withColumns(alone), num, den)
    large = scratch.keep("large", met.join(listed, "hub").withColumn("part", F.pmod(F.xxhash64("v", "u"), F.col("parts")).cast("int")))

    # Each part by itself, together with the seeds.
    seeds = large.where(F.pmod(F.xxhash64(F.lit(1), "v", "u"), F.col("classes")) < SEEDS).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    two = found_links(large.unionByName(seeds).withColumns({"chunk": F.lit(0), "visits": F.lit(0)}), num, den)

    # The classes outside a block's largest group visit the other parts; if they are more than a block, in chunks.
    labels = components(two.select("a", "b").distinct()).withColumnRenamed("v", "c")
    placed = large.select("hub", class_name().alias("c"), F.octet_length("tokens").alias("size")).distinct().join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    groups = placed.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("size"))
    groups = cut(groups)
    largest = groups.groupBy("hub").agg(F.max(F.struct("k", "label")).alias("x")).select("hub", F.col("x.label").alias("giant"))
    outside = groups.join(largest, "hub").where("label <> giant").groupBy("hub").agg(F.ceil(F.sum("size") / block_bytes).cast("int").alias("chunks"))
    outside = cut(outside.join(largest, "hub"))
    found = one.unionByName(two)
    if not outside.isEmpty():
        again = large.join(F.broadcast(outside) if small(outside, "giant") else outside, "hub").withColumn("c", class_name())
        visitors = again.join(labels, "c", "left").where(F.coalesce("label", "c") != F.col("giant"))
        visitors = visitors.withColumns({"own": F.col("part"), "chunk": F.pmod(F.xxhash64(F.lit(2), "v", "u"), F.col("chunks")).cast("int")})
        visitors = visitors.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> own")
        home = again.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        columns = ["hub", "part", "chunk", "v", "u", "tokens"]
        every = home.select(*columns, F.lit(0).alias("visits")).unionByName(visitors.select(*columns, F.lit(1).alias("visits")))
        found = found.unionByName(found_links(every, num, den))
    return cut(found.select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of an edge (a, b); label is the smallest v of the component."""
    both = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")))
    labels = cut(both.groupBy("v").agg(F.least("v", F.min("w")).alias("label")))
    while not labels.isEmpty():
        near = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("low"))
        lower = labels.join(near, "v").select("v", "label", F.least("label", "low").alias("low"))
        up = lower.select(F.col("v").alias("low"), F.col("low").alias("top"))
        jumped = cut(lower.join(up, "low").select("v", F.col("label").alias("was"), F.least("low", "top").alias("label")))
        labels = jumped.select("v", "label")
        if jumped.where("was <> label").isEmpty():
            break
    return labels


def classified(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """(id, t, n, label) of every row: t the hash of its text, n the size of its set, and a label that rows of one component
    share; null for rows without a set. A checkpoint."""
    require(docs, id_col, text_col)
    with Scratch(docs.sparkSession) as scratch:
        text = docs[text_col].cast("string")
        source = docs.select(text.alias("text"), docs[id_col].alias("id"), F.xxhash64(text).alias("t"))
        light, postings = inverted(source, size, num, den, scratch)
        members = blocks(postings)
        by_class = cut(members.groupBy("v").agg(F.collect_list("hub").alias("hubs")))  # at most one hub a prefix shingle
        few = small(by_class, "hubs")
        # Where classes are many, copies are combined before anything is joined.
        wanted = light.where("v IS NOT NULL").join(F.broadcast(by_class.select("v")), "v", "left_semi") if few else light.where("v IS NOT NULL")
        lowest = wanted.groupBy("v", "u").agg(F.min(F.struct("id", "t")).alias("one"), F.max("n").alias("n"))
        chosen = cut(lowest.join(F.broadcast(by_class) if few else by_class, "v"))
        parts = split_blocks(chosen.select(F.explode("hubs").alias("hub"), (8 * F.col("n")).alias("size")))

        def of(batches):
            done: set[tuple[int, int]] = set()
            for batch in sliced(batches):
                own = [shingles(t, size) for t in encoded(batch.column(0))]
                keys = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                keep = [k for k, (s, key) in enumerate(zip(own, keys)) if digest(s) == key and not (key in done or done.add(key))]
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (1, 2, 3)), pa.array([own[k].tobytes() for k in keep], pa.binary())], ["v", "u", "hubs", "tokens"])

        asked = chosen.select(F.col("one.id").alias("id_"), F.col("one.t").alias("t_"), "v", "u", "hubs")
        asked = F.broadcast(asked) if small(chosen, "hubs") else asked
        sets = source.join(asked, (F.col("t") == F.col("t_")) & F.col("id").eqNullSafe(F.col("id_"))).select("text", "v", "u", "hubs")
        sets = sets.mapInArrow(of, "v long, u long, hubs array<long>, tokens binary").select(F.explode("hubs").alias("hub"), "v", "u", "tokens")
        labels = components(links(sets, parts, num, den, scratch)).withColumnRenamed("v", "c")
        named = light.withColumn("c", F.when(F.col("v").isNotNull(), class_name()))
        named = named.join(F.broadcast(labels) if small(labels, "c", "label") else labels, "c", "left")
        return cut(named.select("id", "t", "n", F.coalesce("label", "c").alias("label")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row; documents link if den * intersection >= num * union. A checkpoint."""
    named = classified(docs, id_col, text_col, size, num, den)
    lowest = named.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("lowest"))
    out = named.join(lowest, "label", "left")
    return cut(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("lowest")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns, with one row of each group: that of the smallest id (null last), then text hash."""
    named = classified(docs, id_col, text_col, size, num, den).where("label IS NOT NULL")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    sums = named.groupBy("label").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("k"))
    sums = cut(sums.where("k > 1"))
    if sums.isEmpty():
        return docs
    counted = named.join(F.broadcast(sums) if small(sums, "label") else sums, "label").groupBy("id", "t").agg(F.max(rank == F.col("best")).alias("best"), F.count(F.lit(1)).alias("k"))
    # Rows that go; of a best row that there is several times, all go here and one comes back below.
    gone = cut(counted.where("NOT best OR k > 1").select(F.col("id").alias("_id"), F.col("t").alias("_t"), "best"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(docs[id_col].alias("_of"), F.xxhash64(docs[text_col].cast("string")).alias("_h"), *[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    on = (F.col("_h") == F.col("_t")) & F.col("_of").eqNullSafe(F.col("_id"))
    left = rows.join(F.broadcast(gone) if small(gone) else gone, on, "left_anti").select(*names)
    again = gone.where("best")
    if not again.isEmpty():
        copies = rows.join(F.broadcast(again) if small(again) else again, on, "left_semi")
        left = left.unionByName(copies.groupBy("_of", "_h").agg(F.first(F.struct(*names)).alias("x")).select("x.*"))
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
