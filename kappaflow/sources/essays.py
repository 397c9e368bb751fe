"""Essay split readers (A1, A2) and the ingest step that fixes row keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.operators.checks import require_columns
from kappaflow.schema import RATER1_COLS, RATER2_COLS, REQUIRED_COLUMNS, SPLITS, q


def read_essay_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: one essay CSV split (UTF-8 with or without BOM, header, quoted
    multi-line text), by column name.

    The file's own header counts: required columns may stand in any order,
    other columns are kept as strings, a missing one is an error before any
    row is read.  A rater score that is no number fails the job."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .option("mode", "FAILFAST").csv(path))
    raw = require_columns(raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns]), REQUIRED_COLUMNS)
    return raw.withColumns({c: _score(c) for c in RATER1_COLS + RATER2_COLS})


def _score(name: str):
    text = F.col(q(name))
    number = F.expr(f"try_cast({q(name)} as double)")
    bad = text.isNotNull() & number.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: no number: "), text)).cast("int")).otherwise(number.cast("int"))


def read_essay_splits(spark: SparkSession, paths: Mapping[str, str], id_col: str | None = None) -> DataFrame:
    """A2: the three splits as one frame tagged by ``split``.

    Rows get an explicit ``essay_id``: ``id_col`` when the export has one,
    otherwise an id fixed at ingest (``monotonically_increasing_id`` after
    the union, unique across splits).  Write the result once
    (``ingest_essays``) and read that table afterwards, so ids never change
    between jobs.  Columns that only some splits have are NULL in the others."""
    df = None
    for s, p in paths.items():
        part = read_essay_csv(spark, p).withColumn("split", F.lit(s))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if id_col:
        df = df.withColumn("essay_id", F.col(q(id_col)).cast("bigint"))
        if id_col != "essay_id":
            df = df.drop(id_col)
    else:
        df = df.withColumn("essay_id", F.monotonically_increasing_id())
    # a multi-line CSV file cannot be split: one task per file, then rebalanced.
    # Large exports should come as many files per split.
    return df.repartition("essay_id")


def split_paths(data_dir: str, splits=SPLITS) -> dict[str, str]:
    return {s: f"{data_dir.rstrip('/')}/{s}.csv" for s in splits}


def ingest_essays(spark: SparkSession, paths: Mapping[str, str], out: str, id_col: str | None = None) -> DataFrame:
    """Read the CSV splits once, fix ids, store as parquet partitioned by split."""
    df = read_essay_splits(spark, paths, id_col)
    df.write.mode("overwrite").partitionBy("split").parquet(out)
    return spark.read.parquet(out)
