"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents, with their
values (line dedup changes text and n_chars). Stages that use Python exchange batches of bounded bytes with it, as their
executors serve one stage after the other.

Defined results: null and empty texts aren't toxic, have no lines, shingles or windows, and encode to no ids; texts of any
length are taken whole; of rows that repeat, lines of the first stay, and of a group of near copies the one of the smallest
id (then text hash; null ids last); further columns, whatever their names, pass through all stages but the last; an empty
table of documents, labels or benchmark gives what its stage's module states, and never an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, lines, pieces, suffixes, toxicity
from tidemark.llm.common import Scratch, cut, in_small_batches, unused
from tidemark.llm.queries import table, tokenizer_model

#: SQL can't express the classifier and the encoder.
ORACLE_SQL = None

#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = in_small_batches(docs)
    return toxicity.reject_toxic(docs, table(docs.sparkSession, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, an earlier line anywhere are taken out, and with them documents that have no
    words left; n_chars follows the text."""
    count = unused(docs.columns, "n_removed")
    left = lines.dedup_lines(docs, count=count).where((F.col(count) == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share five-word shingles with a Jaccard similarity of 0.8 or more, one of each group stays."""
    return jaccard.keep_one(in_small_batches(docs), size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    docs = in_small_batches(docs)
    return suffixes.decontaminate(docs, table(docs.sparkSession, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the decoded text."""
    return pieces.encode_decode(in_small_batches(docs), tokenizer_model(), digests=True).drop("decoded")


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next reads them."""
    docs, last = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES[:-1]:
            scratch = Scratch(spark)
            before, last = last, scratch
            try:
                docs = scratch.keep(name, stage(spark, docs, sf_dir))
            finally:
                if before:
                    before.drop()
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        if last:
            last.drop()
