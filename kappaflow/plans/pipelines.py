"""End-to-end jobs: the workflow's entry points as Spark plans.

* ``embedding_job``  - essays -> sentences (per variant) -> vectors -> parquet
* ``training_job``   - vectors -> pooled essay vectors -> fit with early
  stopping -> test predictions -> metrics -> sinks (repeated experiments)
* ``end_to_end``     - first-prompt filter, prompt as first sentence, one run
* ``fine_tune``      - first-five-rows prompt filter, two variants (raw and
  ``<prompt>#`` sentences, sentence cap), one seed per variant, summary

Variants are rows of one frame where the plan allows (C8); the fit itself
runs once per (variant, experiment).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.operators import history as H
from kappaflow.operators import labels as L
from kappaflow.operators import metrics as M
from kappaflow.operators import report as R
from kappaflow.operators import sequence as S
from kappaflow.operators import text as X
from kappaflow.operators.encode import encode_hashing, encode_hashing_once, encode_with_model, fit_hashing_encoder
from kappaflow.operators.minibatch import MinibatchConfig, fit_minibatch
from kappaflow.operators.scorer import ScorerConfig, TraitScorer, fit_scorer, label_frame
from kappaflow.session import drop_path, shared_dir
from kappaflow.schema import BASE_SEED, ESSAY_BATCH, MAX_TOKENS_LABELED, MAX_TOKENS_RAW, VARIANTS
from kappaflow.sources import embeddings as EMB
from kappaflow.sources import sinks

RUN = ["split", "variant", "exp"]


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MODE_TOKENS = {"none": MAX_TOKENS_RAW, "prompt_first": MAX_TOKENS_RAW, "labeled": MAX_TOKENS_LABELED,
               "fine_tune": MAX_TOKENS_LABELED}


def sentence_table(essays: DataFrame, mode: str = "none", max_sentences: int | None = None) -> DataFrame:
    """Every sentence of every essay: (essay_id, split, pos, sentence)."""
    return X.sentence_rows(X.sentences(essays, mode, max_sentences=max_sentences))


def sentence_vectors(essays: DataFrame, mode: str = "none", dim: int = 256, encoder=None,
                     max_sentences: int | None = None,
                     as_vector: bool = False, max_len: int | None = None, path: str | None = None, **tokenizer) -> DataFrame:
    """E1 over every sentence of every essay: keyed (essay_id, split, pos, embedding).
    The built-in encoder fits its IDF on training sentences only; with
    ``as_vector`` it returns sparse ML vectors for immediate pooling, and with a
    ``path`` too it keeps the hashed texts there instead of hashing them twice.  A
    supplied encoder gets ``max_len`` tokens (default: ``MODE_TOKENS``) of the
    ``tokenizer`` given (see ``encode_with_model``)."""
    rows = sentence_table(essays, mode, max_sentences)
    if encoder is None and as_vector and path:
        return encode_hashing_once(rows, path, dim=dim)
    if encoder is None:
        model = fit_hashing_encoder(rows.where(F.col("split") == "train"), dim)
        return encode_hashing(model, rows, as_vector=as_vector)
    return encode_with_model(rows, encoder, max_len or MODE_TOKENS[mode], **tokenizer)


def embedding_job(spark: SparkSession, essays: DataFrame, out: str, variants=VARIANTS, dim: int = 256,
                  encoder=None, encoder_id: str | None = None, **tokenizer) -> DataFrame:
    """Stage 1: vectors for every variant, stored by data revision and encoder
    (A4/A5).  A supplied encoder needs an ``encoder_id`` that changes with it."""
    if encoder is not None and not encoder_id:
        raise ValueError("name the encoder: stored vectors are found again by encoder_id")
    found = None
    for tag, with_prompt in variants:
        mode = "labeled" if with_prompt else "none"
        vec = EMB.materialize_embeddings(
            spark, out, sentence_table(essays, mode),
            lambda m=mode, t=tag: sentence_vectors(essays, m, dim, encoder, **tokenizer).withColumn("variant", F.lit(t)),
            tag, encoder_id or "hashing-tfidf", dim)
        found = vec if found is None else found.unionByName(vec)
    return found


def scoring_frame(essays: DataFrame, vectors: DataFrame, pool: str = "mean") -> DataFrame:
    """Pooled essay vector (E8) next to its eight 0..1 labels."""
    return S.pooled_features(vectors, pool).join(label_frame(essays), ["essay_id", "split"])


def train_and_predict(essays: DataFrame, vectors: DataFrame | Callable[[str], DataFrame], cfg: ScorerConfig, variant: str, exp: int,
                      pool: str = "mean") -> tuple[TraitScorer, DataFrame, DataFrame]:
    """F1 + F2 for one run: returns the scorer, its epoch history and long
    predictions for every essay, with both raters' truth attached.  A
    ``MinibatchConfig`` trains by shuffled batches, a plain one on whole epochs.
    ``vectors`` may be a function of a path, for tables that are dropped once the
    vectors are pooled."""
    spark = essays.sparkSession
    path = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    # texts are encoded once: fit and scoring read the pooled vectors, callers the scored rows
    try:
        found = vectors(f"{path}/hashed") if callable(vectors) else vectors
        frame = _written(scoring_frame(essays, found, pool), f"{path}/frame")
    finally:
        drop_path(spark, f"{path}/hashed")
    fit = fit_minibatch if isinstance(cfg, MinibatchConfig) else fit_scorer
    try:
        scorer, hist = fit(frame, cfg, run_id=f"{variant}/{exp}")
        truth = L.scores_long(essays)
        preds = _written(scorer.transform(frame).join(truth, ["essay_id", "split", "trait"]), f"{path}/preds")
    finally:
        drop_path(spark, f"{path}/frame")
    preds = preds.withColumn("variant", F.lit(variant)).withColumn("exp", F.lit(exp))
    hist = hist.withColumn("variant", F.lit(variant)).withColumn("exp", F.lit(exp))
    return scorer, hist, preds


HIGH_ERRORS = 10


def evaluate(preds: DataFrame, histories: DataFrame, essays: DataFrame, batch_size: int = ESSAY_BATCH["train"],
             previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every report of one training job (I1 - I13, F3, F8) from its predictions.

    The reported loss is a mean over evaluation batches of ``batch_size``
    essays; ``previous`` is the stored rubric report of an earlier run, for
    the regression deltas (I12)."""
    ev = L.evaluation_rows(preds, ["split", "variant", "exp", "trait"])
    per_trait = M.agreement(ev, RUN + ["trait", "rater"])
    loss = H.mse_batch_mean(preds, H.eval_batch_ids(essays, batch_size), RUN)
    stop = H.early_stopping(histories, run_keys=["run_id", "variant", "exp"])
    rubric = M.rubric_report(ev, RUN + ["rater"])
    reports = {} if previous is None else {"regression_delta": _deltas(previous, rubric)}
    return reports | {
        "high_error": R.top_errors(preds, RUN + ["trait"], HIGH_ERRORS),
        "agreement": per_trait,
        "overall": M.agreement(ev, RUN + ["rater"]),
        "trait_mean": M.trait_mean(per_trait, RUN + ["rater"]),
        "experiment_mean": H.experiment_mean(per_trait, ["split", "variant", "trait", "rater"]),
        "rubric_report": rubric,
        "score_distribution": R.score_distribution(preds, RUN + ["trait"]),
        "loss": loss,
        "early_stopping": stop,
        "summary": R.variant_summary(ev, loss, stop, RUN).join(
            loss.where("split = 'valid'").select("variant", "exp", F.col("loss").alias("reloaded_val_loss")), ["variant", "exp"], "left"),
    }


def _deltas(previous: DataFrame, current: DataFrame) -> DataFrame:
    keys = RUN + ["rater", "level", "trait"]
    both = previous.select(*current.columns).withColumn("run", F.lit("previous")).unionByName(
        current.withColumn("run", F.lit("current")))
    return R.regression_delta(R.metrics_long(both, [*keys, "run"]), keys, "run", "previous", "current")


def training_job(spark: SparkSession, essays: DataFrame, vectors: DataFrame, out: str | None = None,
                 variants=VARIANTS, n_exp: int = 1, cfg: ScorerConfig | None = None,
                 batch_size: int = ESSAY_BATCH["train"], previous: DataFrame | None = None,
                 record: dict | None = None) -> dict[str, DataFrame]:
    """Stage 2: per variant and experiment fit, predict, then one evaluation
    over all runs.  Under ``out`` go models, scored rows (written once, the
    reports read them back), test predictions, the summary, every report
    (A6, A7, A8, ``reports/NAME``) and one result record per variant and
    experiment (A9; ``record`` holds what they share).  The summary's
    ``reloaded_val_loss`` is the validation loss of the best epoch's weights."""
    cfg = cfg or ScorerConfig()
    preds, hists, runs = None, None, []
    for v_idx, (tag, _) in enumerate(variants):
        vec = vectors.where(F.col("variant") == tag) if "variant" in vectors.columns else vectors
        for exp in range(n_exp):
            run_cfg = replace(cfg, seed=BASE_SEED + v_idx + 100 * exp)
            scorer, hist, p = train_and_predict(essays, vec, run_cfg, tag, exp)
            if out:
                at = f"{out}/model/{tag}/exp={exp}"
                scorer.save(spark, at)
                runs.append({"variant": tag, "exp": exp, "seed": run_cfg.seed, "model_path": at, "best_epoch": scorer.best_epoch,
                             "best_val_loss": scorer.best_val_loss})
            preds = p if preds is None else preds.unionByName(p)
            hists = hist if hists is None else hists.unionByName(hist)
    if out:
        preds.write.mode("overwrite").parquet(f"{out}/scored")
        preds = spark.read.parquet(f"{out}/scored")
    reports = evaluate(preds, hists, essays, batch_size, previous)
    if out:
        for name, df in reports.items():
            df.write.mode("overwrite").parquet(f"{out}/reports/{name}")
    reports["predictions"] = preds
    reports["history"] = hists
    if out:
        sinks.write_predictions(preds.where(F.col("split") == "test"), f"{out}/predictions")
        sinks.write_summary(reports["summary"].where(F.col("split") == "test"), f"{out}/summary")
        again = {(r["variant"], r["exp"]): r["loss"] for r in reports["loss"].where("split = 'valid'").collect()}
        shared = {"output_path": out, **(record or {})}
        sinks.write_run_records(spark, f"{out}/runs", [
            {"run_id": "run", **shared, **r, "reloaded_val_loss": again.get((r["variant"], r["exp"]))} for r in runs])
    return reports


def end_to_end(spark: SparkSession, essays: DataFrame, out: str | None = None, dim: int = 256,
               encoder=None, cfg: ScorerConfig | None = None, max_len: int | None = None,
               previous: DataFrame | None = None, record: dict | None = None, **tokenizer) -> dict[str, DataFrame]:
    """Essays on the first training prompt, ``prompt:<p>`` as first sentence.
    A supplied encoder reads ``max_len`` ids of the ``tokenizer`` given."""
    e = X.filter_by_prompts(essays, X.first_prompt(essays, 1))
    vec = sentence_vectors(e, "prompt_first", dim, encoder, as_vector=True, max_len=max_len, **tokenizer)
    return training_job(spark, e, vec, out, variants=[("kobert", False)], cfg=cfg,
                        batch_size=ESSAY_BATCH["end_to_end"], previous=previous, record=record)


def fine_tune(spark: SparkSession, essays: DataFrame, out: str | None = None, dim: int = 256,
              encoder=None, cfg: ScorerConfig | None = None,
              max_sentences: int | None = None, max_len: int | None = None, previous: DataFrame | None = None,
              record: dict | None = None, **tokenizer) -> dict[str, DataFrame]:
    """Essays on the prompts of the first five training rows; raw and
    ``<prompt>#`` variants, whole essays unless ``max_sentences`` is given;
    seed 42 + variant index.  A supplied encoder reads ``max_len`` ids (by
    default as many as its variant has) of the ``tokenizer`` given."""
    e = X.filter_by_prompts(essays, X.first_prompt(essays, 5))
    vecs = None
    for tag, with_prompt in VARIANTS:
        v = sentence_vectors(e, "fine_tune" if with_prompt else "none", dim, encoder,
                             max_sentences=max_sentences, as_vector=True, max_len=max_len, **tokenizer).withColumn("variant", F.lit(tag))
        vecs = v if vecs is None else vecs.unionByName(v)
    return training_job(spark, e, vecs, out, variants=VARIANTS, cfg=cfg, batch_size=ESSAY_BATCH["fine_tune"],
                        previous=previous, record=record)
