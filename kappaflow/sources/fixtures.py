"""Essay-shaped views derived from the shared test tables.

The workflow's own data (three essay CSV splits with two raters) is not
public, so these views give tables of the same shape from ``documents`` and
``embeddings``.  Every view reads whole tables, so its size grows with them.
The DuckDB twin of each view lives in ``kappaflow.plans.oracle``.

Joins against fixed tiny lists (traits, variants, experiments) are written as
``explode`` / ``stack`` generators: no cross join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.schema import PROMPT_COL, SENTENCE_SEP, TEXT_COL, TRAITS, q, rater_col

FIXTURE_VARIANTS = ["kobert", "labeled_kobert"]
FIXTURE_EXPS = [0, 1]
EPOCHS_PER_RUN = 100
BATCHES_PER_EPOCH = 100
LONG_SENTENCES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split_of(doc_id: Column) -> Column:
    b = F.pmod(F.floor(doc_id / F.lit(20)).cast("bigint"), F.lit(10))
    return F.when(b < 8, "train").when(b == 8, "valid").otherwise("test")


def essays_from_documents(documents: DataFrame) -> DataFrame:
    """Wide essay table in the workflow's CSV layout plus ``essay_id`` / ``split``.

    Lines of a document are its sentences; ``lang/source`` is the prompt.
    Rater scores are 0..5, the two raters differ by at most one step, and
    ``task_1`` never takes class 1 (so index- and value-weighted kappa differ).
    """
    d = documents.select("doc_id", "text", "lang", "source", "n_chars")
    h = F.col("doc_id") * 7 + F.col("n_chars")
    cols = [
        F.col("doc_id").alias("essay_id"),
        _split_of(F.col("doc_id")).alias("split"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias(PROMPT_COL),
        F.replace(F.col("text"), F.lit("\n"), F.lit(SENTENCE_SEP)).alias(TEXT_COL),
    ]
    r1, r2 = [], []
    for k, trait in enumerate(TRAITS):
        a = F.pmod(h + k, F.lit(6))
        b = F.least(F.lit(5), F.greatest(F.lit(0), a + F.pmod(F.col("doc_id") * 3 + k + h, F.lit(3)) - 1))
        if k == 0:
            a = F.when(a == 1, 0).otherwise(a)
            b = F.when(b == 1, 0).otherwise(b)
        r1.append(a.cast("int").alias(rater_col(1, trait)))
        r2.append(b.cast("int").alias(rater_col(2, trait)))
    return d.select(*cols, *r1, *r2)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-rebalance on ``keys`` only when the source yields fewer input
    partitions than the cluster has cores (one unsplittable file, e.g. a
    multi-line CSV or a single-row-group parquet).  Large sources already
    arrive in many splits and are left alone: no extra shuffle."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        n_in = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD API (e.g. Spark Connect): leave the plan as is
        return df
    if n_in < target:
        return df.repartition(target, *keys)
    return df


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return essays_from_documents(spread(table(spark, sf_dir, "documents"), "doc_id"))


# letters whose share of a text makes its ratings, one per trait
RATED_LETTERS = ["t", "h", "a", "o", "n", "e", "i", "u"]


def text_rated(essay_rows: DataFrame) -> DataFrame:
    """The essays with ratings that their texts decide (and a scorer can
    learn): the share of a trait's letter, in fortieths for one rater and in
    thirty-fifths for the other, cut at 5."""
    text, out = F.coalesce(F.col(q(TEXT_COL)), F.lit("")), essay_rows
    size = F.greatest(F.length(text), F.lit(1))
    for trait, letter in zip(TRAITS, RATED_LETTERS):
        share = (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))) / size
        for rater, scale in ((1, 40), (2, 35)):
            out = out.withColumn(rater_col(rater, trait), F.least(F.lit(5), F.floor(share * scale)).cast("int"))
    return out


DEFECT_EVERY = 50


def defective(essay_rows: DataFrame) -> DataFrame:
    """Essays of which one in 50 has each defect that the checks look for: a
    missing or too large score, no prompt, no text, bytes that are not UTF-8."""
    k = F.pmod(F.col("essay_id"), F.lit(DEFECT_EVERY))
    bad = F.concat(F.col(q(TEXT_COL)), F.unhex(F.lit("FFFE")).cast("string"))
    return (essay_rows
            .withColumn(rater_col(1, TRAITS[0]), F.when(k != 7, F.col(q(rater_col(1, TRAITS[0])))))
            .withColumn(rater_col(2, TRAITS[1]), F.when(k == 8, F.lit(9)).otherwise(F.col(q(rater_col(2, TRAITS[1])))))
            .withColumn(PROMPT_COL, F.when(k != 9, F.col(q(PROMPT_COL))))
            .withColumn(TEXT_COL, F.when(k == 11, bad).when(k != 10, F.col(q(TEXT_COL)))))


LOST_EVERY, STRAY_POS = 97, 100_000


def misaligned(vectors: DataFrame) -> DataFrame:
    """Sentence vectors of which one in 97 stands at a position that no
    sentence has."""
    lost = F.pmod(F.col("essay_id") * 7 + F.col("pos"), F.lit(LOST_EVERY)) == 0
    return vectors.withColumn("pos", F.when(lost, F.col("pos") + STRAY_POS).otherwise(F.col("pos")))


def with_long_essay(essay_rows: DataFrame) -> DataFrame:
    """The essays' prompts and texts, and one more essay of ``LONG_SENTENCES``
    sentences, which a sentence cap cuts at every scale."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(LONG_SENTENCES)),
                                    lambda i: F.concat(F.lit("sentence "), i.cast("string"))), SENTENCE_SEP)
    one = essay_rows.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("essay_id"), F.lit("train").alias("split"),
        F.lit("long").alias(PROMPT_COL), text.alias(TEXT_COL))
    return essay_rows.select("essay_id", "split", F.col(q(PROMPT_COL)), F.col(q(TEXT_COL))).unionByName(one)


def predictions_from_scores(scores_long: DataFrame) -> DataFrame:
    """Stand-in scorer output ``pred01`` in 0..1 for every (essay, variant, exp, trait).

    Values are twentieths, so ``pred01 * 5`` hits exact .5 ties (half-even
    rounding matters); ``task_1`` predictions skip class 1 like its truth.
    """
    fan = F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), F.lit(name).alias("variant"), F.lit(e).alias("exp"))
        for v, name in enumerate(FIXTURE_VARIANTS) for e in FIXTURE_EXPS
    ])).alias("fan")
    s = scores_long.select("essay_id", "split", "trait", "k", "r1", "r2", fan)
    noise = F.pmod(F.col("essay_id") * 13 + F.col("k") * 5 + F.col("fan.v") * 3 + F.col("fan.exp") * 2, F.lit(7))
    n20 = F.least(F.lit(20), F.greatest(F.lit(0), (F.col("r1") + F.col("r2")) * 2 + noise - 3))
    n20 = F.when((F.col("k") == 0) & n20.between(3, 5), F.lit(2)).otherwise(n20)
    return s.select(
        "essay_id", "split", F.col("fan.variant").alias("variant"), F.col("fan.exp").cast("int").alias("exp"),
        "trait", "k", "r1", "r2", (n20.cast("double") / F.lit(20.0)).alias("pred01"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch history of training runs: each run has 100 epochs, one per document.

    val_loss falls as 1/(epoch+2) plus repeatable noise in 0..0.10, so early
    stopping with patience 10 triggers in some runs and not in others.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    run = F.floor(F.col("doc_id") / F.lit(EPOCHS_PER_RUN)).cast("bigint")
    epoch = F.pmod(F.col("doc_id"), F.lit(EPOCHS_PER_RUN)).cast("bigint")
    return d.select(
        run.alias("run_id"),
        F.when(F.pmod(run, F.lit(2)) == 0, FIXTURE_VARIANTS[0]).otherwise(FIXTURE_VARIANTS[1]).alias("variant"),
        F.floor(run / F.lit(2)).cast("int").alias("exp"),
        epoch.alias("epoch"),
        (F.lit(1.0) / (epoch + 3).cast("double")).alias("train_loss"),
        (F.lit(1.0) / (epoch + 2).cast("double")
         + F.pmod(F.col("doc_id") * 37 + F.col("n_chars"), F.lit(11)).cast("double") / F.lit(100.0)).alias("val_loss"),
    )


def spoiled(preds: DataFrame) -> DataFrame:
    """Predictions in which every run has another defect in one essay of 50:
    a missing rating, 5e7, infinity or NaN."""
    bad = F.pmod(F.col("essay_id"), F.lit(50)) == 7
    run = lambda v, e: bad & (F.col("variant") == FIXTURE_VARIANTS[v]) & (F.col("exp") == e)
    pred = (F.when(run(0, 1), F.lit(5e7)).when(run(1, 0), F.lit(float("inf"))).when(run(1, 1), F.lit(float("nan")))
            .otherwise(F.col("pred01")))
    return preds.withColumn("pred01", pred).withColumn("r1", F.when(~run(0, 0), F.col("r1")))


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-batch training loss of two runs, 100 batches per epoch, one per
    document; every fourth epoch has a missing, huge, infinite or NaN loss."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    epoch = F.floor(F.col("doc_id") / F.lit(BATCHES_PER_EPOCH)).cast("bigint")
    batch = F.pmod(F.col("doc_id"), F.lit(BATCHES_PER_EPOCH)).cast("bigint")
    bad = batch == 37
    kind = F.pmod(epoch, F.lit(5))
    loss = (F.when(bad & (kind == 1), F.lit(None).cast("double")).when(bad & (kind == 2), F.lit(5e7))
            .when(bad & (kind == 3), F.lit(float("inf"))).when(bad & (kind == 4), F.lit(float("nan")))
            .otherwise(F.pmod(F.col("n_chars"), F.lit(97)).cast("double") / F.lit(100.0)))
    runs = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
    return d.select(runs.alias("run_id"), epoch.alias("epoch"), batch.alias("batch"), loss.alias("loss")).withColumn(
        "loss", F.col("loss") * (F.col("run_id") + 1))


def sentence_vectors(sentences: DataFrame, embeddings: DataFrame, n_embeddings: int) -> DataFrame:
    """Keyed stand-in for encoder output: every sentence (essay_id, pos) gets one
    row of ``embeddings`` by an equi-join on a derived row id.

    The join side is data-dependent, so no broadcast hint: AQE turns it into a
    broadcast hash join at runtime only when its measured size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    """
    s = sentences.select("essay_id", "split", "pos",
                         F.pmod(F.col("essay_id") * 7 + F.col("pos"), F.lit(n_embeddings)).alias("vec_id"))
    e = embeddings.select("vec_id", "embedding")
    return s.join(e, "vec_id").select("essay_id", "split", "pos", "embedding")
