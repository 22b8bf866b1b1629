"""Sizes of Bloom filters, and membership by double hashing.

Parquet writes and probes its own filters (see sources.store), so these serve planning and checks. A filter here is a table
of words: of bit position p the word number is p / 64 and the bit p % 64.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The target share of false positives, and bounds of the number of probes.
FALSE_POSITIVES, LEAST_PROBES, MOST_PROBES = 0.01, 1, 30


def parameters(n: Column) -> Column:
    """struct<bits, bytes, bits_per_key, probes> for a filter of n > 0 keys."""
    ln2 = math.log(2)
    bits = F.floor(-(n.cast("double")) * F.lit(math.log(FALSE_POSITIVES)) / F.lit(ln2 * ln2))
    per_key = F.ceil(F.lit(-math.log(FALSE_POSITIVES) / (ln2 * ln2)))
    probes = F.greatest(F.lit(LEAST_PROBES), F.least(F.lit(MOST_PROBES), F.floor(per_key * F.lit(ln2)).cast("int")))
    return F.struct(bits.cast("bigint").alias("bits"), F.ceil(bits / 8).cast("bigint").alias("bytes"), per_key.cast("int").alias("bits_per_key"), probes.alias("probes"))


def stored_bits(bits: Column) -> Column:
    """Bits of a filter in whole words, as it is stored. Probes use them all: modulo an odd number strides lose their
    oddness, and modulo a few bits probes of a key fall together (a filter of one key in 9 bits passes 9 in 100)."""
    return (F.ceil(bits / 64) * 64).cast("bigint")


def probe(key: Column, bits: Column, i: Column) -> Column:
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit(1), key).bitwiseOR(F.lit(1))
    return F.pmod(F.pmod(h1, bits) + i * F.pmod(h2, bits), bits)


def probes(key: Column, bits: Column, k: int) -> Column:
    """The k bit positions of a key."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: probe(key, bits, i))


def may_contain(words: Column, key: Column, bits: Column, k: int) -> Column:
    """Whether a filter, as a map of its words without those of no bit, passes a key."""
    at = [probe(key, bits, F.lit(i)) for i in range(k)]
    return functools.reduce(operator.and_, [is_set(words[word_of(p)], p) for p in at])


def word_of(position: Column) -> Column:
    return F.floor(position / 64)


def bit_in_word(position: Column) -> Column:
    """The word with this position's bit set; words of a filter are combined by bit_or."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))


def is_set(word: Column, position: Column) -> Column:
    return F.getbit(F.coalesce(word, F.lit(0).cast("long")), (position % 64).cast("int")) == 1
