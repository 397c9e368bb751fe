"""Score essay files as they land in a folder (Structured Streaming).

The batch workflow has no streaming step; this is the same scoring plan
(sentences -> encoder -> pooling -> trait scorer -> integer scores) applied
per micro-batch.  Each essay row is complete in its file, so no state or
watermark is needed: ``foreachBatch`` runs the batch plan on the new rows and
writes them under ``batch_id=<n>`` with overwrite, which makes a replayed
micro-batch (after a failure) replace its own output instead of duplicating
it.  The checkpoint location must be on shared storage.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.functions.scores import score_int
from kappaflow.operators import sequence as S
from kappaflow.operators import text as X
from kappaflow.operators.encode import encode_hashing
from kappaflow.operators.scorer import TraitScorer


def score_batch(essays: DataFrame, encoder: PipelineModel, scorer: TraitScorer, mode: str = "none") -> DataFrame:
    """The batch scoring plan for new essays: (essay_id, split, trait, pred01, pred)."""
    rows = X.sentence_rows(X.sentences(essays, mode))
    feats = S.pooled_features(encode_hashing(encoder, rows))
    preds = scorer.transform(feats)
    return preds.withColumn("pred", score_int("pred01"))


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str,
                         checkpoint_dir: str, encoder: PipelineModel, scorer: TraitScorer, mode: str = "none",
                         source_format: str = "parquet", available_now: bool = False):
    """Start the stream; returns the ``StreamingQuery``."""
    stream = spark.readStream.format(source_format).schema(schema).load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (score_batch(batch, encoder, scorer, mode).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
