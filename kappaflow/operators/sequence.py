"""Sentence-vector sequences: offsets, positional assignment, regrouping,
padding and pooling.

Sentence vectors are keyed ``(essay_id, pos)``; the positional layout of a
legacy embedding file (rows in essay order, no key) is handled by E4 / E5.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kappaflow.operators.ordering import row_index, running_offset
from kappaflow.session import shared_dir


def _as_double_array(c):
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def sentence_offsets(counts: DataFrame, by=("split",), order=("essay_id",), n_col: str = "n_sentences") -> DataFrame:
    """(start, len) of each essay's rows in a positional file ordered by
    essay_id within its split; start = sum of the lengths of earlier essays.
    Distributed running sum (no single-task window)."""
    return running_offset(counts, list(order), list(by), weight=n_col, out="start")


def assign_by_offset(positional: DataFrame, offsets: DataFrame, by=("split",), row_col: str = "row",
                     n_col: str = "n_sentences", num_partitions: int | None = None) -> DataFrame:
    """E5: give each row of a positional table its (essay_id, pos).

    Both sides are cut alike into ranges of (by, row) and merged in order: a
    row belongs to the essay that starts last at or before it, if the essay is
    long enough.  An essay is one row however many sentences it has, and a
    range whose first rows continue an essay of an earlier range gets that
    essay's row from a small table (one row per range)."""
    by = list(by)
    spark = positional.sparkSession
    rest = [c for c in positional.columns if c not in by and c != row_col]
    rows = positional.select(*by, F.col(row_col).cast("bigint").alias("_at"), F.lit(1).alias("_kind"),
                             F.lit(None).cast("struct<essay_id:bigint,start:bigint,n:bigint>").alias("_e"),
                             F.struct(F.lit(1).alias("_"), *rest).alias("_r"))
    starts = offsets.where(F.col(n_col) > 0).select(
        *by, F.col("start").cast("bigint").alias("_at"), F.lit(0).alias("_kind"),
        F.struct(F.col("essay_id").cast("bigint").alias("essay_id"), F.col("start").cast("bigint").alias("start"),
                 F.col(n_col).cast("bigint").alias("n")).alias("_e"))
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_at"), F.col("_kind")]
    both = (rows.unionByName(starts, allowMissingColumns=True).repartitionByRange(n, *by, *order)
            .withColumn("_p", F.spark_partition_id()))
    root = f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}"
    both.write.parquet(root)
    both = spark.read.schema(both.schema).parquet(root)
    within = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = (both.groupBy(*by, "_p").agg(F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("_at"))).alias("_l"))
               .select(*by, "_p", F.last("_l", ignorenulls=True).over(earlier).alias("_c")))
    found = both.withColumn("_e", F.last("_e", ignorenulls=True).over(within)).where("_kind = 1").join(carried, [*by, "_p"])
    e = F.coalesce("_e", "_c")
    return (found.select(*by, F.col("_at").alias(row_col), "_r", e.alias("_e"))
            .where(F.col(row_col) < F.col("_e.start") + F.col("_e.n"))
            .select(*by, row_col, *[F.col(f"_r.`{c}`") for c in rest], F.col("_e.essay_id").alias("essay_id"),
                    (F.col(row_col) - F.col("_e.start")).cast("int").alias("pos")))


def positional_rows(vectors: DataFrame, offsets: DataFrame, by=("split",), row_col: str = "row") -> DataFrame:
    """Inverse of E5: lay keyed vectors out as a positional file (row = start + pos)."""
    return (vectors.join(offsets.select(*by, "essay_id", "start"), [*by, "essay_id"])
            .select(*by, (F.col("start") + F.col("pos")).alias(row_col), "embedding"))


def essay_sequences(vectors: DataFrame, keys=("essay_id", "split")) -> DataFrame:
    """One row per essay with its vectors ordered by pos.  The output row
    is the whole sequence by definition; pooling (E8) does not build it."""
    g = vectors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("_s"))
    return g.select(*keys, F.size("_s").alias("seq_len"),
                    F.transform("_s", lambda x: x["embedding"].cast("array<double>")).alias("sequence"))


SEQUENCE_CHUNK = 64


def chunked_sequences(vectors: DataFrame, chunk: int = SEQUENCE_CHUNK, keys=("essay_id", "split")) -> DataFrame:
    """E6 with rows of bounded size: (keys, chunk, n, vectors), the vectors of
    ``chunk`` consecutive positions in order.  A group is a chunk, so a long
    essay is many small rows spread over tasks; readers take them in order
    (see ``operators.recurrent``)."""
    g = (vectors.groupBy(*keys, F.floor(F.col("pos") / F.lit(chunk)).cast("bigint").alias("chunk"))
         .agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("_s")))
    return g.select(*keys, "chunk", F.size("_s").alias("n"),
                    F.transform("_s", lambda x: x["embedding"].cast("array<double>")).alias("vectors"))


def padded_length(n: Column) -> Column:
    """The length that a sequence of ``n`` is padded to: four steps to each
    power of two (..., 8, 10, 12, 14, 16, 20, ...), so less than a fifth of a padded
    sequence is padding."""
    # the power of two below n, by its number of binary digits
    digits = F.length(F.bin(F.greatest(n.cast("bigint") - 1, F.lit(0).cast("bigint"))))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(digits - 3, F.lit(0)))
    return F.when(n <= 4, F.greatest(n, F.lit(1)).cast("bigint")).otherwise(F.ceil(n / step) * step)


def length_batches(lengths: DataFrame, dim: int, batch_bytes: int = 64 << 20, by=("split",),
                   length_col: str = "seq_len") -> DataFrame:
    """Batches of essays of about one length.

    ``lengths`` has essay_id, ``by`` and a length.  Essays of one padded length
    are dealt in essay order into batches that fit ``batch_bytes`` of float32
    vectors (one essay at least), so padding is bounded however the lengths
    are spread and a batch is bounded in bytes.  Adds padded_len and batch
    (numbered from 0 within ``by`` and padded_len)."""
    rows = lengths.select("essay_id", *by, F.col(length_col).cast("bigint").alias(length_col))
    rows = rows.withColumn("padded_len", padded_length(F.col(length_col)))
    rows = row_index(rows, ["essay_id"], [*by, "padded_len"], "_row")
    fit = F.greatest(F.floor(F.lit(batch_bytes) / (F.col("padded_len") * F.lit(4 * dim))), F.lit(1))
    return rows.withColumn("batch", F.floor(F.col("_row") / fit).cast("bigint")).drop("_row")


def padding_report(batches: DataFrame, by=("split",), length_col: str = "seq_len") -> DataFrame:
    """Per padded length: essays, batches, real and padded positions and the
    share of padding."""
    g = batches.groupBy(*by, "padded_len").agg(
        F.count(F.lit(1)).alias("n_essays"), (F.max("batch") + 1).alias("n_batches"), F.sum(length_col).alias("positions"),
        F.sum("padded_len").alias("padded_positions"))
    return g.withColumn("padding_share", (F.col("padded_positions") - F.col("positions")) / F.col("padded_positions"))


def pad_batch_chunks(chunks: DataFrame, batches: DataFrame, chunk: int = SEQUENCE_CHUNK, keys=("essay_id", "split")) -> DataFrame:
    """E7 on chunks: the chunk rows of every essay of ``batches``, filled with
    zero vectors up to the padded length; chunks that are padding only are
    added.  No row holds more than ``chunk`` vectors."""
    last = F.floor((F.col("padded_len") - 1) / F.lit(chunk)).cast("bigint")
    slots = batches.select(*keys, "padded_len", "batch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    dim = chunks.agg(F.max(F.size(F.element_at("vectors", 1)))).first()[0] or 0
    rows = slots.join(chunks, [*keys, "chunk"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    here = F.least(F.lit(chunk), F.col("padded_len") - F.col("chunk") * F.lit(chunk)).cast("int")
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), dim), here - F.col("n"))
    return rows.select(*keys, "padded_len", "batch", "chunk", "n",
                       F.concat(F.coalesce("vectors", F.array().cast("array<array<double>>")), zero).alias("vectors"))


def pad_sequences(seqs: DataFrame, length: int | None = None, by=("split",), keys=("essay_id", "split")) -> DataFrame:
    """Right-pad every sequence with zero vectors and keep the true length.

    All sequences come out equally long: ``length`` when given, else the
    longest of their batch (``by``).  A sequence above ``length`` is an error,
    never cut."""
    dim = F.size(F.element_at("sequence", 1))
    zero = F.array_repeat(F.lit(0.0), dim)
    if length is None:
        longest = seqs.groupBy(*by).agg(F.max("seq_len").alias("_len"))  # one row per batch
        rows = seqs.join(longest, list(by))
    else:
        fits = F.col("seq_len") <= F.lit(int(length))
        rows = seqs.withColumn("_len", F.when(fits, F.lit(int(length))).otherwise(
            F.raise_error(F.lit(f"pad_sequences: a sequence is longer than {length}")).cast("int")))
    pad = F.array_repeat(zero, F.col("_len") - F.size("sequence"))
    return rows.select(*keys, "seq_len", F.concat("sequence", pad).alias("padded"))


POOLS = ("mean", "max", "first", "last")


def pool_sequences(vectors: DataFrame, how=POOLS, keys=("essay_id", "split")) -> DataFrame:
    """Reduce each essay's sentence vectors to one ML vector per pooling
    in ``how``, with the number of vectors ``n``.

    Mean and max come from ``Summarizer`` (JVM vector aggregate with bounded
    state per group and map-side partial aggregation, so a very long essay is
    combined across tasks); first / last are ``min_by`` / ``max_by`` on pos.
    ``embedding`` may be an array or an ML vector (sparse vectors stay sparse)."""
    how = [how] if isinstance(how, str) else list(how)
    if not how or set(how) - set(POOLS):
        raise ValueError(f"how must be among {POOLS}")
    emb = vectors.schema["embedding"].dataType
    vec = F.col("embedding") if isinstance(emb, VectorUDT) else array_to_vector(_as_double_array("embedding"))
    pos = ["pos"] if {"first", "last"} & set(how) else []
    sums = [m for m in ("mean", "max") if m in how]
    aggs = [F.count(F.lit(1)).alias("n")]
    if sums:
        aggs.append(Summarizer.metrics(*sums).summary(F.col("_v")).alias("_s"))
    aggs += [f("_v", "pos").alias(name) for name, f in (("first", F.min_by), ("last", F.max_by)) if name in how]
    g = vectors.select(*keys, *pos, vec.alias("_v")).groupBy(*keys).agg(*aggs)
    return g.select(*keys, "n", *[F.col(f"_s.{m}").alias(m) if m in sums else F.col(m) for m in how])


def pooled_features(vectors: DataFrame, how: str = "mean", keys=("essay_id", "split")) -> DataFrame:
    """E8 for the scorer: one pooling as the ``features`` vector."""
    return pool_sequences(vectors, [how], keys).select(*keys, F.col(how).alias("features"))
