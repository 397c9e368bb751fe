"""Data checks before a run: columns, split sizes, encoding, alignment,
revision fingerprint and score domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.schema import MAX_SCORE, PROMPT_COL, RATER1_COLS, RATER2_COLS, REQUIRED_COLUMNS, TEXT_COL, q


class MissingColumnsError(ValueError):
    pass


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """B1: required columns absent from ``df`` (schema only, no job).  A
    Git-LFS pointer read as CSV shows up here as every column missing."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumnsError(f"missing columns: {missing}")
    return df


def split_sizes(essays: DataFrame, by=("split",)) -> DataFrame:
    """B2: essays per split."""
    return essays.groupBy(*by).agg(F.count(F.lit(1)).alias("n_essays"))


def utf8_report(df: DataFrame, cols: Sequence[str], by=("split",)) -> DataFrame:
    """B3 on decoded tables: rows whose text holds bytes that are not UTF-8."""
    bad = None
    for c in cols:
        e = ~F.is_valid_utf8(F.col(q(c)))
        bad = e if bad is None else (bad | e)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("n_invalid_utf8"))


def invalid_utf8_lines(spark: SparkSession, path: str) -> DataFrame:
    """B3 on raw files: the text source keeps the raw bytes of each line, so
    ``is_valid_utf8`` sees exactly what is on disk (the CSV reader would
    already have replaced bad bytes)."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return lines.where(~F.is_valid_utf8("value"))


def embedding_alignment(sentence_rows: DataFrame, vectors: DataFrame, keys=("essay_id", "split", "pos"),
                        by=("split",)) -> DataFrame:
    """Sentence rows and embedding rows must pair one to one on
    (essay_id, pos).  Full outer join, then counts per split."""
    s = sentence_rows.select(*keys).withColumn("_s", F.lit(1))
    v = vectors.select(*keys).withColumn("_v", F.lit(1))
    j = s.join(v, list(keys), "full_outer")
    return j.groupBy(*by).agg(
        F.sum(F.when(F.col("_s").isNotNull() & F.col("_v").isNotNull(), 1).otherwise(0)).cast("bigint").alias("n_matched"),
        F.sum(F.when(F.col("_v").isNull(), 1).otherwise(0)).cast("bigint").alias("n_sentence_only"),
        F.sum(F.when(F.col("_s").isNull(), 1).otherwise(0)).cast("bigint").alias("n_vector_only"))


def split_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, by=("split",)) -> DataFrame:
    """Order-free revision fingerprint per split: row count and the sum of
    row hashes as decimal(38,0) (a bigint sum overflows under ANSI; XOR would
    let duplicate rows cancel).  A row's hash is the first 60 bits of the MD5
    of its values as text, each after its length ("-" for NULL)."""
    cols = [c for c in (cols or df.columns) if c not in by]
    text = [F.col(q(c)).cast("string") for c in cols]
    whole = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])
    h = F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("fingerprint"))


def score_domain(essays: DataFrame, cols: Sequence[str] = tuple(RATER1_COLS + RATER2_COLS),
                 by=("split",), max_score: int = MAX_SCORE) -> DataFrame:
    """Per score column, how many values are NULL or outside 0..max."""
    stack = ", ".join(f"'{c}', CAST({q(c)} AS DOUBLE)" for c in cols)
    long = essays.select(*by, F.expr(f"stack({len(cols)}, {stack}) as (column, value)"))
    bad_range = F.col("value").isNotNull() & (
        ~F.col("value").between(0, max_score) | (F.col("value") != F.floor("value")))
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).cast("bigint").alias("n_null"),
        F.sum(F.when(bad_range, 1).otherwise(0)).cast("bigint").alias("n_out_of_domain"))


def quarantine(essays: DataFrame, score_cols: Sequence[str] = tuple(RATER1_COLS + RATER2_COLS),
               max_score: int = MAX_SCORE) -> tuple[DataFrame, DataFrame]:
    """Split essays into (usable, quarantined).  Quarantined rows keep every
    column plus ``reason`` (``;``-joined: null_text, null_prompt, null_score,
    score_out_of_domain), so nothing is dropped silently.  One narrow filter
    each, no shuffle."""
    tagged = essays.withColumn("_reasons", _reasons(score_cols, max_score))
    good = tagged.where(F.size("_reasons") == 0).drop("_reasons")
    bad = tagged.where(F.size("_reasons") > 0).withColumn("reason", F.array_join("_reasons", ";")).drop("_reasons")
    return good, bad


def _reasons(score_cols: Sequence[str], max_score: int):
    null_score = None
    bad_score = None
    for c in score_cols:
        v = F.col(q(c))
        nn = v.isNull()
        bb = v.isNotNull() & (~v.between(0, max_score) | (v.cast("double") != F.floor(v.cast("double"))))
        null_score = nn if null_score is None else (null_score | nn)
        bad_score = bb if bad_score is None else (bad_score | bb)
    reasons = F.array_compact(F.array(
        F.when(F.col(q(TEXT_COL)).isNull(), F.lit("null_text")),
        F.when(F.col(q(PROMPT_COL)).isNull(), F.lit("null_prompt")),
        F.when(null_score, F.lit("null_score")),
        F.when(bad_score, F.lit("score_out_of_domain"))))
    return reasons


def quarantine_counts(essays: DataFrame, by=("split",), score_cols: Sequence[str] = tuple(RATER1_COLS + RATER2_COLS),
                      max_score: int = MAX_SCORE) -> DataFrame:
    """Rows per split and how many of them are quarantined (one aggregation)."""
    bad = F.size(_reasons(score_cols, max_score)) > 0
    return essays.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("n_quarantined"))
