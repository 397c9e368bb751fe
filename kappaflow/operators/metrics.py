"""Agreement metrics between integer predictions and raters.

Input is the long evaluation table of ``labels.evaluation_rows``: one row per
(group keys, essay, rater) with integer ``yt`` / ``yp``.  The only pass over
those rows builds confusion counts per (group, yt, yp) with map-side partial
aggregation, so a hot group (one trait holding a third of all rows) never
lands whole in one task: one partial row per (task, cell) crosses the
shuffle.  Every metric - accuracy, MAE, RMSE, kappa, per trait or pooled -
is then computed from those counts (at most classes^2 rows per group).

Quadratic weighted kappa follows scikit-learn's ``cohen_kappa_score(...,
weights="quadratic")``: weights are squared differences of class *indices*
in the sorted set of classes present in either vector (``labels="present"``),
not of the scores themselves.  ``labels="fixed"`` uses the scores.  With
sums over the n rows of a group:

    qwk = 1 - n * sum((i-j)^2) / (n * (sum(i^2) + sum(j^2)) - 2 * sum(i) * sum(j))

computed in exact integers (decimal(38,0)) up to one final division; a
group with a single class has a zero denominator and gets NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F




def _dec(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _valid(ev: DataFrame) -> DataFrame:
    # NULL scores are reported by checks.score_domain; metrics use complete pairs.
    return ev.where(F.col("yt").isNotNull() & F.col("yp").isNotNull())


def confusion(ev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per (keys, truth, prediction).  This is the only pass over
    the evaluation rows; every other metric below is derived from it."""
    return _valid(ev).groupBy(*keys, "yt", "yp").agg(F.count(F.lit(1)).alias("n"))


def rollup(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts summed to coarser keys (e.g. all traits pooled)."""
    return conf.groupBy(*keys, "yt", "yp").agg(F.sum("n").alias("n"))


def accuracy_from(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    return conf.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("yt") == F.col("yp"), F.col("n")).otherwise(0)).cast("double")
         / F.sum("n").cast("double")).alias("accuracy"))


def mae_rmse_from(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = (F.col("yt") - F.col("yp")).cast("bigint")
    n = F.sum("n").cast("double")
    return conf.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.abs(d)).cast("double") / n).alias("mae"),
        F.sqrt(F.sum(F.col("n") * d * d).cast("double") / n).alias("rmse"))


def _kappa(n, d2, i2, j2, si, sj) -> Column:
    num = _dec(n) * _dec(d2)
    den = _dec(n) * (_dec(i2) + _dec(j2)) - _dec(si) * _dec(sj) * 2
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - num.cast("double") / den.cast("double"))


def metrics_from(conf: DataFrame, keys: Sequence[str], labels: str = "present") -> DataFrame:
    """n, accuracy, MAE, RMSE and kappa per group from confusion counts.

    A group's cells are gathered in one aggregate - at most (#classes)^2
    structs, bounded by the score scale, never by the rows - and the class
    indices and all sums come from array functions over that short list: one
    shuffle after the confusion pass, no joins."""
    if labels not in ("present", "fixed"):
        raise ValueError("labels must be 'present' or 'fixed'")
    keys = list(keys)
    g = conf.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("yt").cast("bigint").alias("t"), F.col("yp").cast("bigint").alias("p"),
        F.col("n").cast("bigint").alias("n"))).alias("_cells"))
    cells = F.col("_cells")
    if labels == "present":
        classes = F.array_sort(F.array_distinct(F.concat(F.transform(cells, lambda c: c["t"]),
                                                         F.transform(cells, lambda c: c["p"]))))
        g = g.withColumn("_cls", classes)
        idx = lambda v: (F.array_position(F.col("_cls"), v) - 1).cast("bigint")
    else:
        idx = lambda v: v
    zero = F.lit(0).cast("bigint")
    init = F.struct(*[zero.alias(f) for f in ("n", "hit", "ab", "sq", "d2", "i2", "j2", "si", "sj")])

    def step(acc, c):
        i, j, n, d = idx(c["t"]), idx(c["p"]), c["n"], c["t"] - c["p"]
        return F.struct(
            (acc["n"] + n).alias("n"),
            (acc["hit"] + F.when(d == 0, n).otherwise(zero)).alias("hit"),
            (acc["ab"] + n * F.abs(d)).alias("ab"),
            (acc["sq"] + n * d * d).alias("sq"),
            (acc["d2"] + n * (i - j) * (i - j)).alias("d2"),
            (acc["i2"] + n * i * i).alias("i2"),
            (acc["j2"] + n * j * j).alias("j2"),
            (acc["si"] + n * i).alias("si"),
            (acc["sj"] + n * j).alias("sj"))

    s = g.select(*keys, F.aggregate(cells, init, step).alias("_s"))
    x = lambda f: F.col(f"_s.{f}")
    nd = x("n").cast("double")
    return s.select(*keys, x("n").alias("n"),
                    (x("hit").cast("double") / nd).alias("accuracy"),
                    (x("ab").cast("double") / nd).alias("mae"),
                    F.sqrt(x("sq").cast("double") / nd).alias("rmse"),
                    _kappa(x("n"), x("d2"), x("i2"), x("j2"), x("si"), x("sj")).alias("qwk"))


def qwk_from(conf: DataFrame, keys: Sequence[str], labels: str = "present") -> DataFrame:
    """Kappa per group from confusion counts (see module doc)."""
    return metrics_from(conf, keys, labels).select(*keys, "qwk")


def agreement_from(conf: DataFrame, keys: Sequence[str], labels: str = "present") -> DataFrame:
    return metrics_from(conf, keys, labels).select(*keys, "n", "accuracy", "qwk")


def accuracy(ev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I1 (keys include trait) / I3 (pooled over traits)."""
    return accuracy_from(confusion(ev, keys), keys)


def qwk(ev: DataFrame, keys: Sequence[str], labels: str = "present") -> DataFrame:
    """Quadratic weighted kappa per group."""
    return qwk_from(confusion(ev, keys), keys, labels)


def agreement(ev: DataFrame, keys: Sequence[str], labels: str = "present") -> DataFrame:
    """I1 + I2 (+ I6 when ``rater`` is a key): n, accuracy and kappa per
    group, both from one confusion table."""
    return agreement_from(confusion(ev, keys), keys, labels)


def mae_rmse(ev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I7 + I8 on integer scores; sums are exact integers until the division."""
    return mae_rmse_from(confusion(ev, keys), keys)


def trait_mean(per_trait: DataFrame, keys: Sequence[str], cols=("accuracy", "qwk")) -> DataFrame:
    """I4: plain mean over traits of per-trait metrics (not the pooled I3).
    NULL kappas are skipped and counted in ``n_null_qwk``."""
    aggs = [F.avg(c).alias(f"{c}_mean") for c in cols]
    aggs.append(F.count(F.lit(1)).alias("n_traits"))
    if "qwk" in cols:
        aggs.append(F.sum(F.when(F.col("qwk").isNull(), 1).otherwise(0)).alias("n_null_qwk"))
    return per_trait.groupBy(*keys).agg(*aggs)


def rubric_report(ev: DataFrame, run_keys: Sequence[str], labels: str = "present") -> DataFrame:
    """Per-rubric rows and one overall row per run in one table.

    One pass over the evaluation rows builds the per-trait confusion counts;
    the overall rows use the same counts summed over traits (kappa is not
    additive, but its confusion counts are)."""
    run_keys = list(run_keys)
    conf_t = confusion(ev, [*run_keys, "trait"])
    cols = [*run_keys, "level", "trait", "n", "accuracy", "mae", "rmse", "qwk"]
    per_trait = metrics_from(conf_t, [*run_keys, "trait"], labels).withColumn("level", F.lit("trait"))
    overall = (metrics_from(rollup(conf_t, run_keys), run_keys, labels)
               .withColumn("level", F.lit("overall")).withColumn("trait", F.lit("*")))
    return per_trait.select(*cols).unionByName(overall.select(*cols))
