"""Column expressions for labels, score rounding and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kappaflow.schema import MAX_SCORE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label01(r1, r2, max_score: int = MAX_SCORE) -> Column:
    """Training label: mean of the two raters scaled to 0..1."""
    return ((_col(r1) + _col(r2)).cast("double") / F.lit(2.0)) / F.lit(float(max_score))


def to_unit(score, max_score: int = MAX_SCORE) -> Column:
    """Integer score 0..max -> 0..1."""
    return _col(score).cast("double") / F.lit(float(max_score))


def score_int(pred01, max_score: int = MAX_SCORE, clip: bool = True) -> Column:
    """0..1 prediction -> integer 0..max, rounding half to even (2.5 -> 2);
    NaN has no score (NULL), infinities are clipped."""
    p = _col(pred01)
    x = F.rint(p * F.lit(float(max_score)))
    if clip:
        x = F.least(F.lit(float(max_score)), F.greatest(F.lit(0.0), x))
    return F.when(p.isNotNull() & ~F.isnan(p), x).cast("int")


def truncate_int(x) -> Column:
    """Cast toward zero, like numpy ``astype(int)`` (4.9 -> 4)."""
    return _col(x).cast("long").cast("int")


def display_round(x, digits: int = 4) -> Column:
    """Half-even rounding for reports (``np.round``)."""
    return F.bround(_col(x), digits)


RESULT_DIGITS = 9


def stable_round(x, digits: int = RESULT_DIGITS) -> Column:
    """Round half up to ``digits`` places with plain IEEE arithmetic,
    ``floor(x * 10^d + 0.5) / 10^d``.  Unlike ``round`` (which rounds the
    decimal text of a double) every engine gets the same bits for the same
    input, so means whose summation order differs by engine compare equal.
    NaN and very large values pass through unchanged."""
    c = _col(x)
    s = float(10 ** digits)
    small = F.when(~F.isnan(c) & (F.abs(c) < F.lit(1e9)), c)
    r = F.floor(small * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s)
    return F.coalesce(r, c)


def loss_kind(x) -> Column:
    """"nan", "inf" or "finite": what a loss is, next to its rounded value."""
    c = _col(x)
    return F.when(F.isnan(c), "nan").when(F.abs(c) == F.lit(float("inf")), "inf").when(c.isNotNull(), "finite")


def loss_value(x) -> Column:
    """A finite loss, rounded for comparison: ``stable_round`` below 1e9,
    whole millions above; NULL otherwise (see ``loss_kind``)."""
    c = _col(x)
    big = F.floor(c / F.lit(1e6) + F.lit(0.5)).cast("double") * F.lit(1e6)
    return F.when(loss_kind(c) == "finite", F.when(F.abs(c) >= F.lit(1e9), big).otherwise(stable_round(c)))


def loss_kind_sql(expr: str) -> str:
    return f"(CASE WHEN isnan({expr}) THEN 'nan' WHEN isinf({expr}) THEN 'inf' WHEN {expr} IS NOT NULL THEN 'finite' END)"


def loss_value_sql(expr: str) -> str:
    return (f"(CASE WHEN isnan({expr}) OR isinf({expr}) THEN NULL WHEN abs({expr}) >= CAST(1e9 AS DOUBLE) "
            f"THEN floor({expr} / CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(1e6 AS DOUBLE) "
            f"ELSE {stable_round_sql(expr)} END)")


def stable_round_sql(expr: str, digits: int = RESULT_DIGITS) -> str:
    """SQL twin of ``stable_round``."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    return (f"(CASE WHEN isnan({expr}) OR abs({expr}) >= CAST(1e9 AS DOUBLE) THEN {expr} "
            f"ELSE CAST(floor(({expr}) * {s} + CAST(0.5 AS DOUBLE)) AS DOUBLE) / {s} END)")
