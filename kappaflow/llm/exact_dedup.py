"""Exact deduplication of documents by a 128-bit content hash.

Texts are equal when they are identical after lower-casing A-Z (other letters
stay as they are).  Rows are grouped by (hash, normalised text): the hash deals
them out, and Spark's grouping compares the bytes of the texts inside a hash
group, so a collision never merges two texts.  Copies collapse inside each task
before the shuffle, so a group that holds a third of all rows moves one row a
task.  Members then find their group by the hash alone; groups whose hash
turns out to be shared by different texts find theirs by hash and text.  Only
DataFrame operations are used.

Defined results: null text counts as empty; of equal texts the row with the
smallest (or largest) id stays, null ids never stay while another id is there;
rows equal in id and text are one document, marked alike in
``exact_duplicates`` and returned once by ``drop_duplicates``; other columns
pass through ``drop_duplicates`` untouched; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaflow.llm.common import Scratch

CONTENT_HASH = "unhex(md5(body))"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case, null as empty.  A text without other
    than one-byte characters takes the fast way."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _UPPER.lower()))


def _hashed(docs: DataFrame, doc_id: str, text: str, content_hash: str) -> DataFrame:
    return (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), normalised(F.col(text)).alias("body"))
            .withColumn("h", F.expr(content_hash)))


def groups(rows: DataFrame, keep: str) -> DataFrame:
    """(h, body, keep_id, group_size) of every distinct text of ``rows``."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    return rows.groupBy("h", "body").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text",
                     content_hash: str = CONTENT_HASH) -> DataFrame:
    """Every row of ``docs`` as doc_id, keep_id (the id that stays),
    group_size, kept, text_sha256 (of the normalised text) and h (the hash)."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = _hashed(docs, doc_id, text, content_hash)
    found = scratch.write(groups(rows, keep).select("h", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")),
                          "groups")
    shared = scratch.write(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "collisions")
    if shared.isEmpty():
        out = rows.select("doc_id", "h").join(found, "h")
    else:
        apart = groups(rows.join(shared, "h", "left_semi"), keep)
        out = (rows.join(shared, "h", "left_anti").select("doc_id", "h").join(found, "h")
               .unionByName(rows.join(shared, "h", "left_semi").join(apart, ["h", "body"])
                            .withColumn("text_sha256", F.sha2("body", 256)).drop("body")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256", "h")


def drop_duplicates(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text",
                    content_hash: str = CONTENT_HASH) -> DataFrame:
    """``docs`` with one row of each distinct text."""
    kept = (exact_duplicates(docs, keep, doc_id, text, content_hash).filter("kept")
            .select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), F.col("text_sha256").alias("k_sha")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    rows = rows.select("d", F.col(f"d.`{doc_id}`").cast("bigint").alias("id"), normalised(F.col(f"d.`{text}`")).alias("body"))
    rows = rows.withColumn("h", F.expr(content_hash)).withColumn("sha", F.sha2("body", 256))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")) & (F.col("sha") == F.col("k_sha")),
                     "left_semi")
    return rows.dropDuplicates(["id", "h", "body"]).select(*[F.col(f"d.`{c}`") for c in docs.columns])
