import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kappaflow.operators import history as H
from kappaflow.operators import text as X
from kappaflow.operators.encode import (cls_vectors, encode_hashing, encode_with_model, fit_hashing_encoder)
from kappaflow.operators.scorer import ScorerConfig, TraitScorer, fit_scorer
from kappaflow.plans.pipelines import scoring_frame, sentence_vectors
from kappaflow.sources import fixtures as FX
from tests.conftest import SF_SMALL
from tests.models import token_average_encoder


@pytest.fixture(scope="module")
def essays(spark):
    return FX.essays(spark, SF_SMALL).cache()


def test_hashing_encoder_shape_and_norm(spark, essays):
    rows = X.sentence_rows(X.sentences(essays))
    model = fit_hashing_encoder(rows.where("split = 'train'"), dim=32)
    out = encode_hashing(model, rows)
    assert out.count() == rows.count()
    r = out.where(F.size("embedding") == 32).count()
    assert r == rows.count()
    norms = [float(np.linalg.norm(x.embedding)) for x in out.limit(50).collect()]
    assert all(n == pytest.approx(1.0, abs=1e-5) or n == 0.0 for n in norms)


def test_model_hook_batches_and_repartition_invariance(spark, essays):
    rows = X.sentence_rows(X.sentences(essays)).limit(300)
    rows = rows.cache()
    a = {(r.essay_id, r.pos): r.embedding for r in
         encode_with_model(rows, token_average_encoder(dim=8), max_len=20, batch_size=16, rebalance=False).collect()}
    b = {(r.essay_id, r.pos): r.embedding for r in
         encode_with_model(rows, token_average_encoder(dim=8), max_len=20, batch_size=64).collect()}
    assert len(a) == 300 and a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k]) for k in a)
    assert all(len(v) == 8 for v in a.values())


def test_cls_vectors():
    h = np.arange(24).reshape(2, 3, 4)
    assert (cls_vectors(h) == h[:, 0, :]).all()


def test_scorer_fit_history_and_roundtrip(spark, essays, scratch):
    vec = sentence_vectors(essays, "none", dim=16)
    frame = scoring_frame(essays, vec).cache()
    cfg = ScorerConfig(epochs=15, patience=3, lr=0.1)
    scorer, hist = fit_scorer(frame, cfg, run_id="t")
    h = hist.collect()
    assert 1 <= len(h) <= 15
    stop = H.early_stopping(hist, patience=3).first()
    assert stop.best_epoch == scorer.best_epoch
    assert stop.best_val_loss == pytest.approx(scorer.best_val_loss)
    preds = scorer.transform(frame)
    assert preds.count() == frame.count() * 8
    mn, mx = preds.agg(F.min("pred01"), F.max("pred01")).first()
    assert 0.0 <= mn <= mx <= 1.0
    p1 = {(r.essay_id, r.trait): r.pred01 for r in preds.collect()}
    p2 = {(r.essay_id, r.trait): r.pred01 for r in scorer.transform(frame.repartition(7)).collect()}
    assert p1.keys() == p2.keys() and all(p1[k] == pytest.approx(p2[k], abs=1e-12) for k in p1)
    path = os.path.join(scratch, "model")
    scorer.save(spark, path)
    back = TraitScorer.load(spark, path)
    assert back.traits == scorer.traits and np.allclose(back.weights, scorer.weights)
    assert back.best_epoch == scorer.best_epoch


def test_tokenizer_of_a_library_reaches_the_model(spark):
    import public_tokenizers

    from kappaflow.functions.text import model_tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")

    def make_encode():
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]

    def make_model():
        return lambda ids, mask: np.concatenate([ids, mask.sum(axis=1, keepdims=True)], axis=1).astype(np.float32)

    texts = ["Some words here", "", None, "word " * 40]
    rows = spark.createDataFrame([(i, "s", 0, t) for i, t in enumerate(texts)], "essay_id long, split string, pos int, sentence string")
    got = {r.essay_id: r.embedding for r in encode_with_model(
        rows, make_model, max_len=8, tokenizer=model_tokenizer(make_encode), special=(0, 101, 102)).collect()}
    encode = make_encode()
    for i, t in enumerate(texts):
        ids = [101, *encode([t or ""])[0][:6], 102]
        assert got[i] == [float(x) for x in ids + [0] * (8 - len(ids)) + [len(ids)]]


def test_fit_without_improvement_keeps_the_last_epoch(spark):
    from pyspark.ml.linalg import Vectors

    rows = [("train", Vectors.dense([float(i % 5), 1.0]), [0.2 * (i % 5)]) for i in range(40)]
    frame = spark.createDataFrame(rows, ["split", "features", "labels"])
    with pytest.warns(UserWarning, match="no epoch improved"):
        scorer, hist = fit_scorer(frame, ScorerConfig(epochs=4, traits=["t"]))
    h = hist.orderBy("epoch").collect()
    assert len(h) == 4 and scorer.best_epoch == 3 and np.isnan(scorer.best_val_loss)
    assert h[-1].train_loss < h[0].train_loss
    with pytest.raises(ValueError, match="no training rows"):
        fit_scorer(frame.where("split = 'valid'"), ScorerConfig(epochs=2, traits=["t"]))


def test_fit_beats_the_mean(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = 1 / (1 + np.exp(-x @ np.array([1.0, -2.0, 0.5, 0.0])))
    rows = [("train" if i < 200 else "valid", Vectors.dense(x[i].tolist()), [float(y[i])]) for i in range(300)]
    scorer, _ = fit_scorer(spark.createDataFrame(rows, ["split", "features", "labels"]),
                           ScorerConfig(epochs=60, lr=0.1, traits=["t"]))
    assert scorer.best_val_loss < 0.2 * np.mean((y[200:] - y[:200].mean()) ** 2)


def test_missing_labels_fail_instead_of_spoiling_the_model(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, s, Vectors.dense([float(i), 1.0]), [None if i == 3 else 0.4]) for i, s in enumerate(["train", "valid"] * 5)]
    frame = spark.createDataFrame(rows, ["essay_id", "split", "features", "labels"])
    with pytest.raises(Exception, match="is missing"):
        fit_scorer(frame, ScorerConfig(epochs=2, traits=["t"]))
