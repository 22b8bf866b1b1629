"""Quality rules as a bitmask ledger.

Each text is measured once; every rule is evaluated once on the measurements and stored as one bit of `failed` (bit k
for rule k). `write_ledger` stores the ledger as Parquet; policies are versioned masks over its bits, so applying another
version, or asking what each rule costs, reads the ledger and never the texts again. Ablations count the patterns of failed
bits, combined before the shuffle; what each rule costs follows from at most 2 ** rules patterns by bit tests.

Defined results: a null or empty text has no words and fails the rule on word count; texts of any length are measured
whole; an empty table gives an empty ledger, with ablations of 0; repeated rows are judged alike; extra columns are left out
of the ledger unless `keep` names them, and kept columns that are named like the ledger's own, whatever the case, are left
out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chained, encoded, require, with_computed, word_hashes

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")

#: Rule k sets bit k. Order is part of the stored format: append, never reorder.
RULES: dict[str, Column | None] = dict.fromkeys(("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "capitals"))


def rule_conditions() -> dict[str, Column]:
    """True where the rule fails; integer arithmetic, so all engines agree."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "capitals": 2 * c("n_capitals") > c("n_letters"),
    }


#: Which rules a policy version enforces.
POLICIES = {1: ("few_words", "repeated_words"), 2: tuple(RULES)}
CURRENT = 2


def mask(version: int) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[version])


def measured(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    points = len(text.decode())
    blanks = len(text) - len(text.translate(None, SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    letters = len(text) - len(text.translate(None, CAPITALS + CAPITALS.lower()))
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        runs = chained(word_hashes().of(words), 3)
        _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        if twice.any():
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(runs)] |= twice
            repeated = int(covered.sum())
    return len(words), points - blanks, symbols, again, repeated, lines, capitals, letters


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, kept columns, measurements and `failed`, the bits of the rules that it fails."""
    require(docs, id_col, text_col, *keep)

    def fn(pairs):
        for rows, texts in pairs:
            got = [measured(t) for t in encoded(texts)]
            yield rows, [pa.array([g[i] for g in got], pa.int64()) for i in range(len(MEASURES))]

    found = with_computed(docs, text_col, [id_col, *keep], fn, ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(rule_conditions().values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return found.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Ledger rows with `kept` under a policy version."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(version))) == 0)


def write_ledger(docs: DataFrame, path: str, **options) -> DataFrame:
    """Store the ledger at path and read it back."""
    rows = ledger(docs, **options)
    rows.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would be kept without it. One pass over a
    ledger, which counts the patterns of its bits."""
    names, m = list(RULES), mask(version)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])
    listed = rows.sparkSession.range(1).select(F.inline(rules))
    # Every rule with every pattern: at most rules * 2 ** rules rows, whatever the input.
    each = patterns.withColumn("r", F.explode(rules))
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    bit, hit = F.col("r.bit"), F.col("hit")
    sums = each.groupBy(F.col("r.rule").alias("rule")).agg(
        counted(hit.bitwiseAND(bit) != 0).alias("n_failed"),
        counted(hit == bit).alias("n_only"),
        counted(hit.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
        F.sum("n").alias("n_docs"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return listed.join(sums, "rule", "left").select("rule", *map(zero, ("n_failed", "n_only", "n_kept_without", "n_docs")))
