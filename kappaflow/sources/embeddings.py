"""Sentence-embedding storage (A3, A4, A5).

Embeddings are stored keyed ``(variant, split, essay_id, pos)`` in parquet, one
folder per variant, data revision, encoder and length, partitioned by split.  Legacy positional CSV files (one headerless row of floats
per sentence, essays in order) are read with a dense row number and joined
back to their essays through ``operators.sequence.assign_by_offset``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.operators.checks import embedding_alignment, split_fingerprint

EMBEDDING_KEYS = ["variant", "split", "essay_id", "pos"]


def read_embedding_csv(spark: SparkSession, path: str, dim: int, split: str | None = None) -> DataFrame:
    """A3: headerless float32 rows -> (split, row, embedding array<float>).

    The file holds digits only, so it is read as UTF-8.  ``row`` is the
    0-based line number in file order.  Rows are counted per block of a file
    (an input split reads whole blocks, their lines in order); a block starts
    at the count of all blocks before it.  The table of blocks, one row for
    each, is broadcast, so no vector is moved or sorted."""
    schema = T.StructType([T.StructField(f"f{i}", T.FloatType(), True) for i in range(dim)])
    raw = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")]
    mid = F.monotonically_increasing_id().alias("_mid")
    blocks = raw.select(*block, mid).groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")).collect()
    base, start = [], 0
    for b in sorted(blocks, key=lambda b: (b["_file"], b["_at"])):
        base.append((b["_file"], b["_at"], start - b["_first"]))
        start += b["_n"]
    known = F.broadcast(spark.createDataFrame(base, "_file string, _at long, _base long"))
    rows = raw.select(*block, mid, F.array(*[F.col(f"f{i}") for i in range(dim)]).alias("embedding"))
    return rows.join(known, ["_file", "_at"]).select(
        F.lit(split).cast("string").alias("split"), (F.col("_mid") + F.col("_base")).alias("row"), "embedding")


def store_key(rows: DataFrame, variant: str, encoder_id: str, dim: int) -> str:
    """What a stored set of vectors depends on: the sentences (B5 fingerprint
    per split), the variant, the encoder and the vector length."""
    prints = split_fingerprint(rows.select("split", "essay_id", "pos", "sentence")).orderBy("split").collect()
    body = json.dumps([variant, encoder_id, dim, [[r["split"], r["n_rows"], r["fingerprint"]] for r in prints]])
    return hashlib.sha256(body.encode()).hexdigest()[:20]


def write_embeddings(df: DataFrame, path: str) -> None:
    """A5: keyed sentence vectors of one variant, partitioned by split."""
    df.select(*EMBEDDING_KEYS, "embedding").write.mode("overwrite").partitionBy("split").parquet(path)


def read_embeddings(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


class IncompleteEmbeddingsError(ValueError):
    pass


def require_alignment(rows: DataFrame, vectors: DataFrame, dim: int) -> None:
    """B4 as a gate: one vector of length ``dim`` for every sentence row, and
    no other vector."""
    off = [r.asDict() for r in embedding_alignment(rows, vectors).collect() if r["n_sentence_only"] or r["n_vector_only"]]
    wrong = vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).limit(1).count()
    if off or wrong:
        raise IncompleteEmbeddingsError(f"vectors and sentences differ: {off}" if off else f"vectors are not of length {dim}")


def materialize_embeddings(spark: SparkSession, path: str, rows: DataFrame, build, variant: str, encoder_id: str,
                           dim: int) -> DataFrame:
    """A4: compute a variant's vectors once and reuse them afterwards.

    Vectors lie under ``path/variant/<store_key>``, so other data, another
    encoder or another length never finds them.  ``build()`` returns the keyed
    frame; it runs only when the folder lacks Spark's success mark.  Either
    way the result must match ``rows`` (essay_id, split, pos, sentence)."""
    at = f"{path.rstrip('/')}/{variant}/{store_key(rows, variant, encoder_id, dim)}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    fs = mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(mark):
        write_embeddings(build(), at)
    out = read_embeddings(spark, at)
    require_alignment(rows, out, dim)
    return out
