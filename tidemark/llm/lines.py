"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is its words. Lines of min_words words or more that equal an earlier line are removed, and so are lines of
fuzzy_words or more within one word edit (insertion, deletion or substitution) of an earlier line of partner_words or
more; "earlier" compares the first places (id, text hash, line number) of the two lines. Everything else stays as it is,
shorter lines included. By default every line that has a word counts, and edits from five words on against four or more.

For the edits every candidate line emits its variants, the line and the line without word i, as hashed keys. Lines that
share a variant with the same i differ by a substitution, a variant that equals a whole line is an insertion or
deletion. Equal keys are aggregated to their earliest line, so a group yields a pair a member, never all pairs; every
pair's edit distance is then verified on the words.

Variants that can't meet another are not written, which loses no pair. Take lines of n and m words, m = n or n - 1, within
one edit at word p, and k = half(m) <= m / 2. Then p > k, and both begin with the same k words, or p <= n - k, and both
end with the same k words, as an edit changes one place only. Every line of partner_words or more writes both keys for pairs
whose smaller line has n, and for those where it has n - 1 words, so two such lines share a key of this pair's m; lines
that share no key with another line have no partner. A line that shares first words only has its edits behind them, one
that shares last words only has them before those, so only variants without a word there can meet.

The hash of a line is the exclusive or of hashes of its words with their places, so the variants of a line follow from
running sums of these over its words, and a line of n words costs n steps, not n * n.

Defined results: null and empty texts stay; texts and lines of any length are taken whole; rows with equal id and text
count as one document; rows that share an id only are documents of their own, ordered by text hash; null ids come first;
extra columns are kept, but one named like the count of removed lines, whatever the case, is left out; a document may end
up with an empty text; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, require, small, without_names

#: Fewest words of a line whose exact copies go, whose near copies go, and of the earlier lines these are compared with.
MIN_WORDS, FUZZY_WORDS, PARTNER_WORDS = 1, 5, 4
BLANKS = r"[\x20\x09-\x0D]+"
#: Words in a block of running sums.
BLOCK = 256


def words_of(line: Column) -> Column:
    """Words between blanks; only lines with blanks other than spaces need a regular expression."""
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, BLANKS)).otherwise(F.split(line, " ")), "")


def few(df: DataFrame, *sized: str) -> DataFrame:
    """df, broadcast if its bytes allow it."""
    return F.broadcast(df) if small(df, *sized) else df


def half(m: Column) -> Column:
    """How many words of a line are its first (or last) half in a pair whose smaller line has m words."""
    return F.greatest(F.lit(1), 2 * F.floor((m - 1) / 4).cast("int"))


def half_keys(words: Column, n: Column) -> Column:
    """Keys of the first and last words for pairs of smaller size n and n - 1, which mostly have the same half. The lowest
    bit tells first (0) from last."""

    def both(m: Column) -> list[Column]:
        k = half(m)
        first, last = F.xxhash64(k, F.slice(words, F.lit(1), k)), F.xxhash64(k, F.slice(words, n - k + 1, k))
        return [first.bitwiseAND(F.lit(-2)), last.bitwiseOR(F.lit(1))]

    return F.when(half(n) == half(n - 1), F.array(*both(n))).otherwise(F.array(*both(n), *both(n - 1)))


def running(sums: Column, block: Column, k: Column) -> Column:
    """The sum of the first k numbers, from the sums before each block and those within it."""
    at = F.floor(k / BLOCK).cast("int")
    return F.get(sums, at).bitwiseXOR(F.when(at < F.size(block), F.get(F.get(block, at), k - at * BLOCK)).otherwise(F.lit(0).cast("long")))


def with_running(rows: DataFrame, name: str, numbers: Column) -> DataFrame:
    """rows with columns name_b (within blocks of BLOCK numbers the running exclusive-or sums, from 0 on) and name_s (the sums
    before each block, and of all). Each step is a column that the next refers to twice, so Spark doesn't repeat it."""
    rows = rows.withColumn(f"{name}_n", numbers)
    zero = F.array(F.lit(0).cast("long"))
    add = lambda got, x: F.array_append(got, F.element_at(got, -1).bitwiseXOR(x))
    listed = F.col(f"{name}_n")
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(listed) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(listed, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    rows = rows.withColumn(f"{name}_b", block)
    return rows.withColumn(f"{name}_s", F.aggregate(f"{name}_b", zero, lambda got, b: add(got, F.element_at(b, -1)))).drop(f"{name}_n")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one edit."""
    p = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    n, m = F.size(a), F.size(b)
    from_p, after = F.greatest(p, F.lit(1)), p + 1
    return (
        F.when(p == 0, F.lit(True))
        .when(n == m, F.slice(a, after, n) == F.slice(b, after, m))
        .when(n == m + 1, F.slice(a, after, n) == F.slice(b, from_p, n))
        .when(m == n + 1, F.slice(a, from_p, m) == F.slice(b, after, m))
        .otherwise(F.lit(False))
    )


def removed_lines(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, partner_words: int = PARTNER_WORDS) -> DataFrame:
    """(id, r, line) of every line to remove; r is the hash of id and text."""
    if not 1 <= min_words <= partner_words <= fuzzy_words or partner_words < 2:
        raise ValueError("1 <= min_words <= partner_words <= fuzzy_words and 2 <= partner_words must hold")
    text = docs[text_col].cast("string")
    whole_docs = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], text).alias("r"), text.alias("text"))

    def worded(rows: DataFrame) -> DataFrame:
        made = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line"), words_of(line).alias("words")))
        return rows.select("id", "r", F.inline(F.filter(made, lambda x: F.size(x["words"]) >= min_words))).withColumn("n", F.size("words"))

    keys = F.when(F.col("n") >= partner_words, half_keys(F.col("words"), F.col("n")))
    light = worded(whole_docs).select("id", "r", "line", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(7), "words").alias("b"), keys.alias("keys"))
    light = scratch.keep("lines", light)
    place = F.struct("id", "r", "line")
    firsts = scratch.keep("firsts", light.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")))

    # Lines that share a half with another one, and which halves.
    halves = light.select("a", F.explode("keys").alias("key"))
    shared = cut(halves.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("key"))
    sides = halves.join(few(shared), "key").groupBy("a").agg(F.bit_or(F.col("key").bitwiseAND(F.lit(1)).cast("int") + 1).alias("sides"))
    at = cut(firsts.join(sides, "a").select("a", "b", "first", "sides", F.col("first.r").alias("r"), F.col("first.line").alias("line")))
    lines = worded(whole_docs.join(few(at.select("r")), "r", "left_semi")).join(few(at), ["r", "line"]).where(F.col("id").eqNullSafe(F.col("first.id")))
    lines = scratch.keep("candidates", lines.select("a", "b", "first.*", "sides", "words").dropDuplicates(["a", "b"]))

    # The half that a line shares is as it is, so the edit lies behind a first half, or before a last one.
    n, h = F.size("words"), half(F.size("words") - 1)
    here = lambda i: (i == 0) | ((n >= fuzzy_words) & (((F.col("sides") != 2) & (i > h)) | ((F.col("sides") != 1) & (i <= n - h))))
    spread = lines.select("id", "r", "line", "a", "b", "words", F.filter(F.sequence(F.lit(0), n), here).alias("places")).repartition("a", "b")
    spread = with_running(spread, "here", F.transform("words", lambda w, j: F.xxhash64(w, j)))
    spread = with_running(spread, "moved", F.transform("words", lambda w, j: F.xxhash64(w, j - 1)))  # behind a word taken out
    all_words, all_moved = F.element_at("here_s", -1), F.element_at("moved_s", -1)
    behind = lambda i: all_moved.bitwiseXOR(running(F.col("moved_s"), F.col("moved_b"), i))
    left = lambda i: F.when(i == 0, all_words).otherwise(running(F.col("here_s"), F.col("here_b"), i - 1).bitwiseXOR(behind(i)))
    variants = spread.select("id", "r", "line", "a", "b", F.inline(F.transform("places", lambda i: F.struct(left(i).alias("v"), i.alias("i")))))
    variants = scratch.keep("variants", variants)
    twice = cut(variants.groupBy("v").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("v"))
    me = F.struct(place.alias("first"), F.struct("a", "b").alias("k"))
    variants = scratch.keep("met", variants.join(few(twice), "v").select("v", "i", me.alias("me")))

    # Each way to meet is written by a run of its own: a plan of all of them would start its many stages at once, and the
    # driver's heap grows by what each start takes. Lines that meet in two ways would differ in size both ways, so these
    # don't repeat each other's pairs.
    def pairs(name: str, found: DataFrame) -> DataFrame:
        earlier = found.where(F.col("lead.first") < F.col("me.first"))
        return scratch.keep(name, earlier.select("me.k.a", "me.k.b", F.col("lead.k.a").alias("a2"), F.col("lead.k.b").alias("b2")).distinct())

    gone, whole = variants.where("i > 0"), variants.where("i = 0").select("v", F.col("me").alias("full"))
    by_place = gone.groupBy("v", "i").agg(F.min("me").alias("lead"), F.max("me").alias("tail")).where("lead <> tail").select("v", "i", "lead")
    substituted = pairs("substituted", gone.join(by_place, ["v", "i"]).select("me", "lead"))
    shorter = pairs("shorter", gone.join(whole, "v").select("me", F.col("full").alias("lead")))
    longer = pairs("longer", whole.join(gone.groupBy("v").agg(F.min("me").alias("lead")), "v").select(F.col("full").alias("me"), "lead"))
    theirs = lines.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("their_words"))
    met = substituted.unionByName(shorter).unionByName(longer).join(lines.select("a", "b", "words"), ["a", "b"]).join(theirs, ["a2", "b2"])
    near_copies = met.where((n >= fuzzy_words) & one_edit(F.col("words"), F.col("their_words"))).select("a", "b").distinct()
    near_copies = scratch.keep("near", near_copies).withColumn("near", F.lit(True))

    # Only lines that occur again or are near copies can have places to remove.
    some = cut(firsts.join(near_copies, ["a", "b"], "left").where("copies > 1 OR near").select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near")))
    hit = light.select("id", "r", "line", "a", "b").join(few(some), ["a", "b"])
    return hit.where(F.col("near") | (place > F.col("first"))).select("id", "r", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS, partner_words: int = PARTNER_WORDS, count: str = "n_removed") -> DataFrame:
    """All columns of docs with later copies of lines taken out of the text, and how many as the column `count`."""
    require(docs, id_col, text_col)
    word, bit = F.floor(F.col("line") / 64).cast("int"), F.expr("shiftleft(1L, line % 64)")
    with Scratch(docs.sparkSession) as scratch:
        gone = removed_lines(docs, id_col, text_col, scratch, min_words, fuzzy_words, partner_words).groupBy("id", "r", word.alias("w")).agg(F.bit_or(bit).alias("bits"))
        gone = cut(gone.groupBy(F.col("id").alias("_id"), F.col("r").alias("_r")).agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("_gone")))
    kept = without_names(docs.columns, count)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_of"), text.alias("_text"), F.xxhash64(docs[id_col], text).alias("_t"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(kept)])
    met = rows.join(few(gone, "_gone"), (F.col("_t") == F.col("_r")) & F.col("_of").eqNullSafe(F.col("_id")), "left")
    left = F.filter(F.split("_text", "\n"), lambda line, i: F.coalesce(F.getbit(F.element_at("_gone", F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64))) == 0, F.lit(True)))
    n = F.coalesce(F.aggregate(F.map_values("_gone"), F.lit(0).cast("long"), lambda s, b: s + F.bit_count(b)), F.lit(0).cast("long"))
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    return met.select(*[(new if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(kept)], n.alias(count))
