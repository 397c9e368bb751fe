"""Loss, batching and epoch-history operators.

A training loop logs one row per epoch to a ``history`` table (run_id,
epoch, train_loss, val_loss) and one row per batch to ``batch_losses``.
These operators answer the loop's questions as DataFrame jobs: batch
membership, MSE, running loss, early-stopping point and best epoch.
Windows here are partitioned per run / epoch, whose size is bounded by the
number of epochs (batches), never by the number of essays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kappaflow.functions.scores import label01
from kappaflow.operators.ordering import row_index
from kappaflow.schema import BASE_SEED, PATIENCE



def _sq_err(pred="pred01"):
    d = F.col(pred) - label01("r1", "r2")
    return d * d


def mse_loss(preds: DataFrame, keys) -> DataFrame:
    """plain MSE over every (essay, trait) value of a run that has a
    prediction and both ratings (``n`` counts them); a NaN or infinite
    prediction shows in the loss."""
    return preds.groupBy(*keys).agg(F.count(_sq_err()).alias("n"), F.avg(_sq_err()).alias("mse"))


def eval_batch_ids(essays: DataFrame, batch_size: int, by=("split",)) -> DataFrame:
    """F4 (evaluation loader): batches of ``batch_size`` essays in essay_id
    order within each split; the last batch may be short."""
    idx = row_index(essays.select("essay_id", *by), ["essay_id"], list(by), "row")
    return idx.select("essay_id", *by, F.floor(F.col("row") / F.lit(batch_size)).cast("bigint").alias("batch"))


CELL_ROWS = 4096


def train_batch_ids(essays: DataFrame, batch_size: int, epoch: int, seed: int = BASE_SEED,
                    by=("split",)) -> DataFrame:
    """F4 + F9 (training loader): a seeded shuffle per epoch, then batches.

    The shuffle order is the MD5 of "seed:epoch:essay_id" - reproducible and
    independent of partitioning, unlike ``rand()``.  Nothing is sorted as a
    whole: essays fall into cells by the first digits of their hash, about
    ``CELL_ROWS`` to a cell, a cell starts at the count of all cells before
    it, and ranks run within cells."""
    by = list(by)
    e = essays.select("essay_id", *by, F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("essay_id").cast("string"))).alias("_h"))
    n = essays.count()
    digits = 0
    while n > CELL_ROWS * 16 ** digits:
        digits += 1
    e = e.withColumn("_c", F.substring("_h", 1, digits))
    # the first half of the digits, then the rest: no window holds all cells
    cells = e.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_a", F.substring("_c", 1, digits // 2))
    before = lambda *g: Window.partitionBy(*by, *g).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    coarse = (cells.groupBy(*by, "_a").agg(F.sum("_n").alias("_n"))
              .select(*by, "_a", F.coalesce(F.sum("_n").over(before().orderBy("_a")), zero).alias("_s")))
    cells = cells.join(coarse, [*by, "_a"]).select(
        *by, "_c", (F.col("_s") + F.coalesce(F.sum("_n").over(before("_a").orderBy("_c")), zero)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(*by, "_c").orderBy("_h", "essay_id")) - 1
    return (e.withColumn("_r", rank).join(cells, [*by, "_c"])
            .select("essay_id", *by, F.lit(epoch).alias("epoch"),
                    F.floor((F.col("_s") + F.col("_r")) / F.lit(batch_size)).cast("bigint").alias("batch")))


def mse_batch_mean(preds: DataFrame, batches: DataFrame, keys) -> DataFrame:
    """F3 as the loop reports it: mean over batches of each batch's MSE (a
    short last batch weighs as much as a full one)."""
    j = preds.join(batches.select("essay_id", "split", "batch"), ["essay_id", "split"])
    per_batch = j.groupBy(*keys, "batch").agg(F.avg(_sq_err()).alias("_bm"))
    return per_batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_batches"),
                                        F.avg("_bm").alias("loss"))


REPORTS_PER_BLOCK = 1_000


def running_loss(batch_losses: DataFrame, every: int = 10, by=("run_id", "epoch")) -> DataFrame:
    """running mean of the batch loss within a run's epoch, reported after
    every ``every``-th batch.

    Batches are first summed per report, reports run within blocks of
    ``REPORTS_PER_BLOCK`` and blocks add what earlier blocks hold, so no task
    sees all batches of an epoch."""
    by = list(by)
    report = F.floor(F.col("batch") / F.lit(every)).cast("bigint")
    r = (batch_losses.groupBy(*by, report.alias("_r"))
         .agg(F.sum("loss").alias("_s"), F.count("loss").alias("_n"), F.max("batch").alias("batch"))
         .withColumn("_b", F.floor(F.col("_r") / F.lit(REPORTS_PER_BLOCK)).cast("bigint")))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (r.groupBy(*by, "_b").agg(F.sum("_s").alias("_bs"), F.sum("_n").alias("_bn"))
              .select(*by, "_b", F.coalesce(F.sum("_bs").over(before), F.lit(0.0)).alias("_s0"),
                      F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0")))
    w = Window.partitionBy(*by, "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_s", F.coalesce(F.sum("_s").over(w), F.lit(0.0))).withColumn("_n", F.sum("_n").over(w)).join(blocks, [*by, "_b"])
    n = F.col("_n") + F.col("_n0")
    return (r.where(F.pmod(F.col("batch") + 1, F.lit(every)) == 0)
            .select(*by, "batch", F.when(n > 0, (F.col("_s") + F.col("_s0")) / n).alias("running_loss")))


def early_stopping(history: DataFrame, patience: int = PATIENCE, run_keys=("run_id",),
                   max_epochs: int | None = None) -> DataFrame:
    """F6 + F7 per run.

    An epoch improves when its val_loss is strictly below every earlier one
    (a tie is not an improvement; a NaN never improves).  The loop stops at
    the first epoch that ends ``patience`` epochs without improvement.  The
    best epoch is the last improving epoch up to the stop (the earliest
    minimum), whose checkpoint is reloaded before testing."""
    run_keys = list(run_keys)
    h = history if max_epochs is None else history.where(F.col("epoch") < max_epochs)
    w_prev = Window.partitionBy(*run_keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    w_cum = Window.partitionBy(*run_keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    prev_min = F.min("val_loss").over(w_prev)
    improved = F.col("val_loss") < F.coalesce(prev_min, F.lit(float("inf")))
    x = h.select(*run_keys, "epoch", "val_loss", improved.alias("improved"))
    x = x.withColumn("last_improved", F.max(F.when(F.col("improved"), F.col("epoch"))).over(w_cum))
    x = x.withColumn("stale", F.col("epoch") - F.coalesce(F.col("last_improved"), F.lit(-1)))
    stop = x.groupBy(*run_keys).agg(
        F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.max("epoch").alias("last_epoch"))
    y = x.join(stop, run_keys).where(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return y.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("epochs_run"),
        F.max("stop_epoch").alias("stop_epoch"),
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.min(F.when(F.col("improved"), F.col("val_loss"))).alias("best_val_loss"),
    ).withColumn("stopped_early", F.col("stop_epoch").isNotNull())


def experiment_mean(per_exp: DataFrame, keys, cols=("accuracy", "qwk")) -> DataFrame:
    """F8: average per-experiment metrics over repeated experiments."""
    return per_exp.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_exp"),
        *[F.avg(c).alias(f"{c}_mean") for c in cols])
