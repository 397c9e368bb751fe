"""From raw documents to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame; all but the
last return the columns of ``documents``.  Every stage works on all that the
one before kept:

1. quality    documents that the importance resampling does not draw go
2. lines      lines that repeat an earlier line go; documents of which nothing
              is left go with them (all they hold stands in earlier ones)
3. near_dups  of each component of near-duplicate documents the one of the
              smallest doc_id stays
4. benchmark  documents that contain a benchmark item go
5. packing    what is left becomes sequences of 2048 ids (one row per piece,
              with its ids)

``run`` writes each stage to shared storage and reads it back, so a lost
executor never repeats more than the stage at work; then the stage's scratch
tables and the table it read go.  SQL cannot express the
stages (trained models, tokenizer), so ``ORACLE_SQL`` is None; the tests hold
them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.llm import decontamination, importance, line_dedup, odd_minhash, packing
from kappaflow.llm.common import Scratch, released_scratch, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return importance.keep_good(docs, good)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    count = "n_removed"
    while count in docs.columns:
        count += "_"
    cut = line_dedup.dedup_lines(docs, count=count)
    out = cut.filter(f"`{count}` = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    shorter = F.when(F.col(count) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", shorter).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return odd_minhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_dups", near_dups), ("benchmark", benchmark), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with released_scratch(), small_batches(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    with small_batches(spark):
        return STAGES[-1][1](spark, docs, sf_dir)
