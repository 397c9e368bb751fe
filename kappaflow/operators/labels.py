"""Rater columns, long score form, training labels and integer predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaflow.functions.scores import label01, score_int, truncate_int
from kappaflow.schema import RATER1_COLS, RATER2_COLS, TRAITS, q, rater_col


def rater_columns(essays: DataFrame, rater: int, keys=("essay_id",)) -> DataFrame:
    """Keys plus the eight ``rater{n}@{trait}`` columns of one rater."""
    cols = RATER1_COLS if rater == 1 else RATER2_COLS
    return essays.select(*keys, *[F.col(q(c)) for c in cols])


def scores_long(essays: DataFrame, keys=("essay_id", "split")) -> DataFrame:
    """C2 + C4: wide rater columns -> one row per (essay, trait) with integer
    scores of both raters.  ``stack`` is a generator: no shuffle, no join."""
    parts = []
    for k, t in enumerate(TRAITS):
        parts += [f"'{t}'", str(k), q(rater_col(1, t)), q(rater_col(2, t))]
    stacked = essays.select(*keys, F.expr(f"stack({len(TRAITS)}, {', '.join(parts)}) as (trait, k, r1, r2)"))
    return stacked.select(*keys, "trait", F.col("k").cast("int").alias("k"),
                          truncate_int("r1").alias("r1"), truncate_int("r2").alias("r2"))


def trait_labels(scores: DataFrame) -> DataFrame:
    """Training label = mean of the two raters / 5, in 0..1."""
    return scores.withColumn("label", label01("r1", "r2"))


def predicted_scores(predictions: DataFrame, pred_col: str = "pred01") -> DataFrame:
    """G1 + G2: 0..1 prediction -> integer 0..5 (half to even, clipped)."""
    return predictions.withColumn("pred", score_int(pred_col))


def evaluation_rows(predictions: DataFrame, keys=("split", "variant", "exp", "trait")) -> DataFrame:
    """Long evaluation table: one row per (keys, essay, rater) with integer
    truth ``yt`` and integer prediction ``yp``.  Both raters are rows of one
    frame, so every metric runs once for both (I6)."""
    p = predictions.select(*keys, "essay_id", score_int("pred01").alias("yp"), "r1", "r2")
    return p.select(*keys, "essay_id", "yp",
                    F.expr("stack(2, 'r1', r1, 'r2', r2) as (rater, yt)"))
