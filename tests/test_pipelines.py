import os

import pytest
from pyspark.sql import functions as F

from kappaflow.operators.scorer import ScorerConfig, TraitScorer
from kappaflow.plans import pipelines as PL
from kappaflow.schema import TRAITS
from kappaflow.sources import fixtures as FX
from tests.conftest import SF_SMALL

CFG = ScorerConfig(epochs=4, patience=2)


def test_end_to_end_plan_with_sinks(spark, scratch):
    essays = FX.essays(spark, SF_SMALL)
    out = os.path.join(scratch, "e2e")
    rep = PL.end_to_end(spark, essays, out=out, dim=16, cfg=CFG)
    kept = essays.join(PL.X.first_prompt(essays, 1).withColumnRenamed("prompt", "question@prompt"),
                       "question@prompt", "left_semi").count()
    assert rep["predictions"].select("essay_id").distinct().count() == kept
    assert rep["summary"].where("split = 'test'").count() == 1
    wide = spark.read.option("header", True).csv(f"{out}/predictions")
    assert set(TRAITS) <= set(wide.columns)
    summary = spark.read.option("header", True).csv(f"{out}/summary")
    assert {"r1_acc_mean", "r1_qwk_mean", "r2_acc_mean", "r2_qwk_mean", "test_loss",
            "best_val_loss"} <= set(summary.columns)
    assert TraitScorer.load(spark, f"{out}/model/kobert/exp=0").weights.shape == (8, 16)


def test_fine_tune_two_variants(spark):
    essays = FX.essays(spark, SF_SMALL)
    rep = PL.fine_tune(spark, essays, dim=16, cfg=CFG)
    variants = {r.variant for r in rep["summary"].select("variant").distinct().collect()}
    assert variants == {"kobert", "labeled_kobert"}
    stop = rep["early_stopping"].collect()
    assert len(stop) == 2 and all(r.epochs_run <= 4 for r in stop)
    report = rep["rubric_report"].where("level = 'overall'").collect()
    assert all(0.0 <= r.accuracy <= 1.0 for r in report)


def test_embedding_job_writes_each_variant_once(spark, scratch):
    essays = FX.essays(spark, SF_SMALL)
    out = os.path.join(scratch, "emb")
    vec = PL.embedding_job(spark, essays, out, dim=8)
    n_sent = essays.select(F.size(F.split(F.col("`answer@text`"), "#@문장구분#", -1)).alias("n")) \
                   .agg(F.sum("n")).first()[0]
    assert vec.where("variant = 'kobert'").count() == n_sent
    assert vec.where("variant = 'labeled_kobert'").count() == n_sent
    assert vec.select(F.size("embedding").alias("d")).distinct().first().d == 8


def test_cli_on_csv_splits(spark, scratch):
    from kappaflow.__main__ import parse, run
    from kappaflow.schema import REQUIRED_COLUMNS
    essays = FX.essays(spark, SF_SMALL)
    data = os.path.join(scratch, "data")
    os.makedirs(data)
    for split in ("train", "valid", "test"):
        pdf = essays.where(F.col("split") == split).orderBy("essay_id").select(*[f"`{c}`" for c in REQUIRED_COLUMNS]) \
                    .toPandas()
        pdf.to_csv(os.path.join(data, f"{split}.csv"), index=False, encoding="utf-8-sig")
    out = os.path.join(scratch, "out")
    run(spark, parse(["train", "--data-dir", data, "--out", out, "--dim", "8", "--epochs", "3", "--patience", "2"]))
    ingested = spark.read.parquet(f"{out}/essays")
    assert ingested.count() == essays.count()
    assert ingested.select("essay_id").distinct().count() == essays.count()
    assert spark.read.option("header", True).csv(f"{out}/summary").count() == 2
    reports = {n: spark.read.parquet(f"{out}/reports/{n}") for n in sorted(os.listdir(f"{out}/reports"))}
    assert set(reports) >= {"agreement", "high_error", "rubric_report", "score_distribution", "trait_mean", "loss", "summary"}
    assert all(r.count() > 0 for r in reports.values())
    delta = PL._deltas(reports["rubric_report"], reports["rubric_report"])
    assert delta.where("delta <> 0 or flagged").count() == 0 and delta.where("baseline is not null").count() > 0
    runs = spark.read.parquet(f"{out}/runs").collect()
    assert {(r.variant, r.exp, r.seed) for r in runs} == {("kobert", 0, 42), ("labeled_kobert", 0, 43)} and len(runs) == 2
    assert all(r.entry_point == "train" and "train" in r.data_revision and r.best_epoch >= 0 for r in runs)
    assert all(abs(r.reloaded_val_loss - r.best_val_loss) < 1e-9 for r in runs)


def test_jobs_hand_the_tokenizer_to_the_encoder(spark):
    essays = FX.essays(spark, SF_SMALL)

    def fixed(text_col):
        return F.transform(F.split(F.lower(text_col), " "), lambda w: F.lit(77))

    def make():
        import numpy as np

        def predict(ids, mask):
            n = mask.sum(axis=1)
            assert ids.shape[1] == 12 and set(np.unique(ids[:, 1:])) <= {77, 13, 11} and (ids[:, 0] == 12).all()
            return np.stack([n, n * 0 + 1.0], axis=1).astype("float32")
        return predict

    rep = PL.end_to_end(spark, essays, encoder=make, cfg=CFG, max_len=12, tokenizer=fixed, special=(11, 12, 13))
    assert rep["predictions"].count() > 0
    assert "reloaded_val_loss" in rep["summary"].columns


def test_texts_are_not_encoded_again_for_predictions(spark, scratch):
    from kappaflow.operators.scorer import ScorerConfig
    from kappaflow.plans.pipelines import sentence_vectors, train_and_predict
    from kappaflow.schema import TEXT_COL, TRAITS, rater_col

    essays = spark.range(60).selectExpr("id as essay_id", "if(id % 4 = 0, 'valid', 'train') as split",
                                        f"concat('word ', id % 7, '#other ', id) as `{TEXT_COL}`")
    for k, t in enumerate(TRAITS):
        for r in (1, 2):
            essays = essays.selectExpr("*", f"cast((essay_id + {k}) % 6 as int) as `{rater_col(r, t)}`")
    essays.write.parquet(f"{scratch}/essays")
    essays = spark.read.parquet(f"{scratch}/essays")
    _, _, preds = train_and_predict(essays, sentence_vectors(essays, "none", 8, as_vector=True), ScorerConfig(epochs=2), "kobert", 0)
    assert preds.count() == 60 * len(TRAITS) and not [f for f in preds.inputFiles() if f"{scratch}/essays" in f]


def test_hashed_texts_are_kept_between_fit_and_encoding(spark, scratch):
    from kappaflow.plans.pipelines import scoring_frame, sentence_vectors, train_and_predict
    from kappaflow.operators.scorer import ScorerConfig
    from kappaflow.schema import SENTENCE_SEP, TEXT_COL, TRAITS, rater_col

    essays = spark.range(40).selectExpr("id as essay_id", "if(id % 4 = 0, 'valid', 'train') as split",
                                        f"concat('Word ', id % 7, '{SENTENCE_SEP}other\t', id, '{SENTENCE_SEP}{SENTENCE_SEP}') as `{TEXT_COL}`")
    for k, t in enumerate(TRAITS):
        for r in (1, 2):
            essays = essays.selectExpr("*", f"cast((essay_id + {k}) % 6 as int) as `{rater_col(r, t)}`")
    essays.write.parquet(f"{scratch}/kept-essays")
    essays = spark.read.parquet(f"{scratch}/kept-essays")
    once = sentence_vectors(essays, "none", 8, as_vector=True, path=f"{scratch}/hashed")
    assert not [f for f in once.inputFiles() if "kept-essays" in f]  # encoding reads no text again
    twice = sentence_vectors(essays, "none", 8, as_vector=True)

    def rows(v):
        return sorted((r["essay_id"], r["split"], r["pos"], r["embedding"].toArray().tolist()) for r in v.collect())
    assert rows(once) == rows(twice) and len(rows(once)) == 160
    seen = []

    def made(at):
        seen.append(at)
        return sentence_vectors(essays, "none", 8, as_vector=True, path=at)
    _, hist, preds = train_and_predict(essays, made, ScorerConfig(epochs=2), "kobert", 0)
    _, want, _ = train_and_predict(essays, twice, ScorerConfig(epochs=2), "kobert", 0)
    assert preds.count() == 40 * len(TRAITS) and not os.path.exists(seen[0].removeprefix("file:").replace("//", "/"))
    assert [r["val_loss"] for r in hist.collect()] == pytest.approx([r["val_loss"] for r in want.collect()])
