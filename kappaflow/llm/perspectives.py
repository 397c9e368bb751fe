"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and all others as named users; only what the
assistant says is trained on.  The rendering comes as ordered segments, one
row per turn and perspective, each with its place in the rendered dialogue
and its mask span, so a conversation of any length is never one row or one
task; joining the segments of a perspective in order gives the whole text.

Template (a segment is header, text and END):
  narrator          <|system|>\\n
  the perspective   <|assistant|>\\n
  anybody else      <|user:NAME|>\\n
The mask covers the assistant's text and END; other segments have none.

Defined results: turns go by number, nulls last, ties by role and text;
repeated rows are repeated segments; a null text is empty; a turn without
role or conversation is nobody's: it belongs to speaker "unknown" or to a null
conversation like any other; narrators (by default "system") get no
perspective; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kappaflow.llm.common import Scratch

END = "<|end|>\n"
NARRATORS = ("system",)
PARTITION_ROWS = 100_000


def _before(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of a group.  Rows lie range-ordered
    in numbered parts (``part``) of bounded size: sums run within a part, and
    the totals of earlier parts, one row per group and part, are added."""
    inner = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows.groupBy(*group, "part").agg(F.sum(value).alias("t"))
              .withColumn("base", F.coalesce(F.sum("t").over(outer), F.lit(0))).drop("t")
              .withColumnsRenamed({c: f"g_{c}" for c in (*group, "part")}))
    same = F.col("part") == F.col("g_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    return (rows.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(totals, same).withColumn(out, F.col(out) + F.col("base"))
            .drop("base", "g_part", *[f"g_{g}" for g in group]))


def rotate(turns: DataFrame, narrators: Sequence[str] = NARRATORS) -> DataFrame:
    """(conv_id, perspective, seq, turn, speaker, segment, start, end,
    mask_start, mask_end); positions count characters from 0, mask bounds are
    null where nothing is trained on."""
    scratch = Scratch(turns.sparkSession, "perspectives")
    said = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    said = scratch.write(said.withColumn("uid", F.monotonically_increasing_id()), "turns")
    narrator = F.col("speaker").isin(*narrators)
    people = (said.filter(~narrator).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
              .distinct())
    header = (F.when(narrator, F.lit("<|system|>\n"))
              .when(F.col("speaker") == F.col("perspective"), F.lit("<|assistant|>\n"))
              .otherwise(F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n"))))
    rows = (said.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
            .withColumn("chars", (F.length(header) + F.length("text") + len(END)).cast("bigint"))
            .withColumn("one", F.lit(1).cast("bigint")).withColumn("last", F.col("turn").isNull()))
    order = ["last", "turn", "speaker", "text", "uid"]
    rows = scratch.write(rows, "segments")
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    rows = scratch.write(rows.repartitionByRange(parts, "conv_id", "perspective", *order)
                         .withColumn("part", F.spark_partition_id()), "parts")
    who = ["conv_id", "perspective"]
    rows = _before(_before(rows, who, order, "one", "seq"), who, order, "chars", "start")
    trained = F.col("speaker") == F.col("perspective")
    return rows.select("conv_id", "perspective", "seq", "turn", "speaker",
                       F.concat(header, "text", F.lit(END)).alias("segment"), "start",
                       (F.col("start") + F.col("chars")).alias("end"),
                       F.when(trained, F.col("start") + F.length(header)).alias("mask_start"),
                       F.when(trained, F.col("start") + F.col("chars")).alias("mask_end"))
