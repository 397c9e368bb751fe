"""Regression-check reports: score distribution, high-error examples,
run-to-run deltas and the per-variant summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kappaflow.functions.scores import label01, score_int
from kappaflow.operators import metrics as M
from kappaflow.schema import MAX_SCORE



def score_distribution(preds: DataFrame, keys: Sequence[str], max_score: int = MAX_SCORE) -> DataFrame:
    """Predictions per score bucket 0..max (empty buckets as 0) and the
    share of each bucket in its group."""
    keys = list(keys)
    counts = preds.groupBy(*keys, score_int("pred01").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    # every group gets all buckets: a generator over the (small) distinct groups
    buckets = counts.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(max_score))).alias("pred"))
    full = buckets.join(counts, [*keys, "pred"], "left").fillna(0, subset=["n"])
    total = F.sum("n").over(Window.partitionBy(*keys))
    return full.select(*keys, "pred", F.col("n").cast("bigint").alias("n"),
                       (F.col("n").cast("double") / total.cast("double")).alias("share"))


def top_errors(preds: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Top-k essays by absolute error per group (ties: lower essay_id).

    ``row_number() <= k`` plans with a partial WindowGroupLimit before the
    shuffle, so each task ships at most k rows per group."""
    err = F.col("pred01") - label01("r1", "r2")
    e = preds.select(*keys, "essay_id", err.alias("err"))
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col("err")).desc(), F.col("essay_id").asc())
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def high_error(preds: DataFrame, keys: Sequence[str], run_col: str, previous, current, k: int = 10) -> DataFrame:
    """Top-k high-error examples of the previous and the current run side
    by side (an essay may be in one list only).  One top-k window over both
    runs, then one conditional aggregation per (keys, essay) - the same rows
    as a full outer join of the two lists, from a single branch."""
    keys = list(keys)
    both = preds.where(F.col(run_col).isin(previous, current))
    top = top_errors(both, [*keys, run_col], k)
    is_prev, is_cur = F.col(run_col) == F.lit(previous), F.col(run_col) == F.lit(current)
    return top.groupBy(*keys, "essay_id").agg(
        F.max(F.when(is_prev, F.col("rank"))).alias("prev_rank"),
        F.max(F.when(is_prev, F.col("err"))).alias("prev_err"),
        F.max(F.when(is_cur, F.col("rank"))).alias("cur_rank"),
        F.max(F.when(is_cur, F.col("err"))).alias("cur_err"))


def metrics_long(report: DataFrame, keys: Sequence[str], metrics=("accuracy", "qwk", "mae", "rmse")) -> DataFrame:
    """Wide metric report -> (keys, metric, value)."""
    stack = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    return report.select(*keys, F.expr(f"stack({len(metrics)}, {stack}) as (metric, value)"))


def regression_delta(long_metrics: DataFrame, keys: Sequence[str], run_col: str, baseline, candidate,
                     tolerance: float = 0.01) -> DataFrame:
    """Candidate - baseline per metric, flagged past ``tolerance``.
    Both runs are read in one pass and paired by a conditional aggregation
    (rows present in one run only keep a NULL on the other side)."""
    keys = list(keys)
    m = long_metrics.where(F.col(run_col).isin(baseline, candidate))
    d = m.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col(run_col) == F.lit(baseline), F.col("value"))).alias("baseline"),
        F.max(F.when(F.col(run_col) == F.lit(candidate), F.col("value"))).alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    return d.select(*keys, "metric", "baseline", "candidate", delta.alias("delta"),
                    (F.abs(delta) > F.lit(tolerance)).alias("flagged"))


def variant_summary(ev: DataFrame, test_loss: DataFrame, stopping: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Per run: best validation loss, test loss and the mean over traits
    of accuracy and kappa against each rater (the per-variant summary file)."""
    run_keys = list(run_keys)
    per_trait = M.agreement(ev, [*run_keys, "rater", "trait"])
    means = M.trait_mean(per_trait, [*run_keys, "rater"])
    wide = means.groupBy(*run_keys).agg(
        *[F.max(F.when(F.col("rater") == r, F.col(f"{m}_mean"))).alias(f"{r}_{m}_mean")
          for r in ("r1", "r2") for m in ("accuracy", "qwk")])
    wide = (wide.withColumnRenamed("r1_accuracy_mean", "r1_acc_mean")
                .withColumnRenamed("r2_accuracy_mean", "r2_acc_mean"))
    out = wide.join(test_loss.select(*run_keys, F.col("loss").alias("test_loss")), run_keys, "left")
    shared = [k for k in run_keys if k in stopping.columns]
    return out.join(stopping.select(*shared, "best_val_loss").distinct(), shared, "left")
