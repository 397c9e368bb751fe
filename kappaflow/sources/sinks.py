"""Result writers."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.functions.scores import score_int
from kappaflow.schema import TRAITS


def predictions_wide(preds: DataFrame, keys=("essay_id", "split", "variant", "exp"),
                     pred_col: str = "pred01") -> DataFrame:
    """Long predictions -> one row per essay, integer score per trait
    column.  Pivot values are listed, so no extra job collects them."""
    p = preds.select(*keys, "trait", score_int(pred_col).alias("pred"))
    return p.groupBy(*keys).pivot("trait", TRAITS).agg(F.max("pred"))


def write_predictions(preds: DataFrame, path: str, partition_by=("variant", "exp")) -> None:
    """A6 sink: CSV with header and the 8 trait columns, keyed by essay_id."""
    (predictions_wide(preds).write.mode("overwrite").option("header", True)
     .partitionBy(*partition_by).csv(path))


def write_summary(summary: DataFrame, path: str) -> None:
    """The per-variant summary (one row per run) as CSV.  The frame is
    bounded by the number of runs, so a single output file is fine."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


RUN_RECORD_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("entry_point", T.StringType(), True),
    T.StructField("commit", T.StringType(), True),
    T.StructField("data_revision", T.StringType(), True),
    T.StructField("seed", T.LongType(), True),
    T.StructField("settings", T.StringType(), True),
    T.StructField("output_path", T.StringType(), True),
    T.StructField("model_path", T.StringType(), True),
    T.StructField("recorded_at", T.TimestampType(), True),
])


RUN_KEYS = ["run_id", "variant", "exp"]


def write_run_records(spark: SparkSession, path: str, records: list[dict]) -> DataFrame:
    """One result record per run, variant and experiment, each with its own
    seed and the facts of its reloaded model.  The table is partitioned by
    these keys and a write replaces just its own partitions, so a rerun of a
    run leaves one record for each."""
    fields = [f for f in RUN_RECORD_SCHEMA.fields if f.name != "run_id"]
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("variant", T.StringType()),
                           T.StructField("exp", T.IntegerType()), *fields,
                           T.StructField("best_epoch", T.LongType()), T.StructField("best_val_loss", T.DoubleType()),
                           T.StructField("reloaded_val_loss", T.DoubleType())])
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for r in records:
        r = {**r, "settings": json.dumps(r.get("settings") or {}, sort_keys=True), "recorded_at": now}
        rows.append(tuple(r.get(f.name) for f in schema.fields))
    df = spark.createDataFrame(rows, schema)
    (df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEYS).parquet(path))
    return df


def append_run_record(spark: SparkSession, path: str, run_id: str, entry_point: str, commit: str | None = None,
                      data_revision: str | None = None, seed: int | None = None, settings: dict | None = None,
                      output_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """Append one result record (entry point, commit, data revision,
    seed, settings, paths) to the ``runs`` table."""
    row = (run_id, entry_point, commit, data_revision, seed, json.dumps(settings or {}, sort_keys=True),
           output_path, model_path, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
    df = spark.createDataFrame([row], RUN_RECORD_SCHEMA)
    df.write.mode("append").parquet(path)
    return df
