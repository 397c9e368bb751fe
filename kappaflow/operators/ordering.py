"""Running positions in a global order without a single-task window.

``Window.partitionBy("split").orderBy("essay_id")`` moves a whole split into
one task.  Instead: range-partition on (by, order) so every task holds a
contiguous key range, take running sums inside each task, and add the total
of all earlier tasks from a small table (one row per task and group) that is
broadcast after its row count is checked.  The ranges are written with the rows
to shared storage, so no job repeats them and no cache is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.session import drop_path, shared_dir

MAX_BROADCAST_OFFSET_ROWS = 1_000_000


def _local_running(by: list[str]):
    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carry: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            w = pdf["_w"].astype("int64")
            if by:
                keys = (pd.Series(list(pdf[by].itertuples(index=False, name=None)), index=pdf.index)
                        if len(by) > 1 else pdf[by[0]])
                before = pdf.assign(_w=w).groupby(by, sort=False, dropna=False)["_w"].cumsum() - w
                before = before + keys.map(carry).fillna(0).astype("int64")
                ends = pd.DataFrame({"k": keys, "e": before + w}).drop_duplicates("k", keep="last")
                carry.update(zip(ends["k"], ends["e"].astype("int64")))
            else:
                c = carry.get(None, 0)
                before = w.cumsum() - w + c
                carry[None] = int(before.iloc[-1] + w.iloc[-1])
            yield pdf.assign(_pid=pid, _before=before.astype("int64"))
    return run


def running_offset(df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (),
                   weight: str | None = None, out: str = "offset",
                   num_partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``weight`` (row count when None) in the order
    of ``order_cols`` within each ``by`` group.  ``(by, order_cols)`` must be
    a unique key.  Pass a narrow frame: every column crosses into Arrow once.
    """
    by, order_cols = list(by), list(order_cols)
    keys = by + order_cols
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    root = f"{shared_dir(spark)}/order-{uuid.uuid4().hex}"
    # range partitioning samples its input in a job of its own: the narrow rows
    # are written, so that what they come from (a scan of all texts, say) runs once
    src = _written(df.select(*keys, w.alias("_w"), *[c for c in df.columns if c not in keys]), f"{root}/rows")
    ranged = (src.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys])
              .sortWithinPartitions(*keys))
    schema = T.StructType(ranged.schema.fields + [
        T.StructField("_pid", T.IntegerType(), False), T.StructField("_before", T.LongType(), False)])
    local = _written(ranged.mapInPandas(_local_running(by), schema), f"{root}/parts")
    drop_path(spark, f"{root}/rows")
    totals = local.groupBy("_pid", *by).agg(F.sum("_w").alias("_tot"))
    wnd = (Window.partitionBy(*by) if by else Window).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _written(totals.select("_pid", *by, F.coalesce(F.sum("_tot").over(wnd), F.lit(0)).cast("bigint").alias("_off")),
                       f"{root}/offsets")
    if offsets.count() <= MAX_BROADCAST_OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    same = F.col("l._pid") == F.col("o._pid")
    for c in by:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
    res = local.alias("l").join(offsets.alias("o"), same).select(
        *[F.col(f"l.`{c}`") for c in df.columns], (F.col("o._off") + F.col("l._before")).alias(out))
    return res


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_index(df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (), out: str = "row_index",
              num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order within ``by``."""
    return running_offset(df, order_cols, by, None, out, num_partitions)
