import os

from pyspark.sql import functions as F

from kappaflow.operators.scorer import ScorerConfig, fit_scorer
from kappaflow.operators import text as X
from kappaflow.operators.encode import fit_hashing_encoder
from kappaflow.plans.pipelines import scoring_frame, sentence_vectors
from kappaflow.sources import fixtures as FX
from kappaflow.streaming.scoring import score_batch, start_scoring_stream
from tests.conftest import SF_SMALL


def test_stream_scores_new_files_once(spark, scratch):
    essays = FX.essays(spark, SF_SMALL).cache()
    rows = X.sentence_rows(X.sentences(essays))
    encoder = fit_hashing_encoder(rows.where("split = 'train'"), dim=16)
    scorer, _ = fit_scorer(scoring_frame(essays, sentence_vectors(essays, "none", 16)),
                           ScorerConfig(epochs=3, patience=2))
    src, out, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    essays.where("essay_id < 100").write.parquet(os.path.join(src, "part1"))
    q = start_scoring_stream(spark, os.path.join(src, "*"), essays.schema, out, ckpt, encoder, scorer,
                             available_now=True)
    q.awaitTermination(120)
    essays.where("essay_id >= 100").write.parquet(os.path.join(src, "part2"))
    q = start_scoring_stream(spark, os.path.join(src, "*"), essays.schema, out, ckpt, encoder, scorer,
                             available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == essays.count() * 8
    assert got.select("essay_id").distinct().count() == essays.count()
    assert got.select("batch_id").distinct().count() == 2
    direct = {(r.essay_id, r.trait): r.pred for r in score_batch(essays, encoder, scorer).collect()}
    streamed = {(r.essay_id, r.trait): r.pred for r in got.collect()}
    assert direct == streamed
    assert got.agg(F.min("pred"), F.max("pred")).first()[0] >= 0
