"""URL filter lists: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is (host, path, verdict). It fits a URL whose host is the rule's host or one of its subdomains and whose path
starts with the rule's path. Every URL is expanded into the expressions host suffix + path prefix that some rule could
equal: suffixes of as many labels, and prefixes of as many characters, as any rule has. Expressions meet rules by an
equi-join on the first 32 bits of their SHA-256 alone; which of the rules with that prefix fit is then confirmed by the
full digests. Of several rules the longest wins (host and path together, then the longer host, then block before allow).

Rules are broadcast up to BROADCAST_BYTES; beyond that both sides are shuffled by hash prefix, the rules copied and the
URLs salted, so that an expression which a third of all URLs share (such as a top-level domain) is spread out.

Defined results: a null or empty URL, or one without `://`, has empty host and path and gets the default verdict; URLs and
rule paths of any length are taken whole (each length that some rule's path has costs a digest a host suffix); repeated
rows are all judged; columns besides id and URL, whatever their names, are left out; an empty page table gives an empty
one, an empty rule table gives every URL the default; rules with a null host or path are ignored, and of equal rules
with different verdicts `block` holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, require

#: Hex digits of a digest that are joined on, and copies of the rules where they are too many to broadcast.
PREFIX_DIGITS, SALTS = 8, 16
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def short_hash(digest: Column, digits: int = PREFIX_DIGITS) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def digested(host: Column, path: Column) -> Column:
    """A host holds no slash and a line break can't be confused with one, so the two parts stay apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES, prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages. rules: host, path, verdict."""
    require(pages, id_col, url_col)
    require(rules, "host", "path", "verdict")
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    size = F.octet_length("rule_host") + F.octet_length("rule_path") + 256
    bounds = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    url = pages[url_col].cast("string")
    parts = pages.select(pages[id_col].alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not bounds.n:
        return parts.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.lit(sorted(bounds.labels)), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(F.lit(sorted(bounds.lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digested(h, p))))
    expanded = parts.select("_id", "host", "path", F.posexplode_outer(pairs).alias("k", "digest")).withColumn("hash", short_hash(F.col("digest"), prefix_digits))
    ruled = rules.select(
        digested(F.col("rule_host"), F.col("rule_path")).alias("digest"),
        F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule")).alias("found"),
    )
    # One row a prefix, so an expression meets at most one row, however many rules share its prefix.
    listed = ruled.groupBy(short_hash(F.col("digest"), prefix_digits).alias("rule_hash")).agg(F.collect_list(F.struct("digest", "found")).alias("rules"))
    on = F.col("hash") == F.col("rule_hash")
    if bounds["size"] <= broadcast_bytes:
        met = expanded.join(F.broadcast(listed), on, "left")
    else:
        salted = listed.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expanded.withColumn("salt", F.pmod(F.xxhash64("_id", "host", "path"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("salt") == F.col("rule_salt")), "left")
    confirmed = F.get(F.filter("rules", lambda r: r["digest"] == F.col("digest")), F.lit(0))["found"]
    # Each URL's expressions lie together, so the partial sums leave one row of each page for the shuffle.
    best = met.groupBy("_id", "host", "path").agg(F.max(confirmed).alias("found"), F.sum((F.coalesce("k", F.lit(0)) == 0).cast("int")).alias("copies"))
    each = best.select(F.col("_id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return each.drop("_copy")
