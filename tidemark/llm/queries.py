"""The queries opN_<name> over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_model() -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


#: (host, path, verdict) of the rules that op1 applies.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import grouped

    return grouped(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    with Scratch(spark) as scratch:  # the archives go once they are read
        manifest = write_archives(table(spark, sf_dir, "pages"), f"{scratch.base}/warc")
        rows = read_archives(spark, manifest, with_payload=False, records_col="records").where("kind = 'record'")
        return cut(rows.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import mark

    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_policy, mask, write_ledger

    with Scratch(spark) as scratch:
        ledger = write_ledger(table(spark, sf_dir, "documents"), f"{scratch.base}/ledger")
        rows = apply_policy(ledger).withColumn("kept_v1", F.col("failed").bitwiseAND(F.lit(mask(1))) == 0)
        return cut(rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("kept_v1")).alias("base_failed"), "kept", "failed", "kept_v1"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import write_shards

    with Scratch(spark) as scratch:
        rows = write_shards(table(spark, sf_dir, "documents"), f"{scratch.base}/shards", 24)
        text = F.coalesce(F.col("text"), F.lit(""))
        size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
        return cut(rows.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, as_text, find

    rows = find(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, BASE), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_model(), lists=False, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_ngram_jaccard, op4_warc, op5_decontamination, op6_quality_rules, op7_sharding, op8_line_dedup, op9_pii, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    """The others (a classifier, seeded shuffles, boosted trees, an encoder) are tested against plain versions."""
    from . import oracles

    return {
        "op1_url_filters": oracles.url_filters(URL_RULES),
        "op3_ngram_jaccard": oracles.NGRAM_JACCARD,
        "op4_warc": oracles.WARC,
        "op5_decontamination": oracles.DECONTAMINATION,
        "op6_quality_rules": oracles.QUALITY,
        "op8_line_dedup": oracles.LINE_DEDUP,
    }
