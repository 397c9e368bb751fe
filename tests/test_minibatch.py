import hashlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from kappaflow.operators import history as H
from kappaflow.operators.minibatch import MinibatchConfig, fit_minibatch


def data(seed=0, n=400, dim=5):
    rng = np.random.default_rng(seed)
    X, A = rng.normal(size=(n, dim)), rng.normal(size=(2, dim))
    Y = 1 / (1 + np.exp(-(X @ A.T)))
    split = np.array(["train", "train", "train", "valid", "test"])[np.arange(n) % 5]
    return X, Y, split


def frame(spark, X, Y, split):
    return spark.createDataFrame([(i, str(s), Vectors.dense(x), y.tolist()) for i, (x, y, s) in enumerate(zip(X, Y, split))],
                                 ["essay_id", "split", "features", "labels"]).repartition(3)


def plain(X, Y, split, cfg):
    """The same loop over arrays; steps of one pass share the weights before it."""
    order = lambda ids, epoch: sorted(ids, key=lambda i: (hashlib.md5(f"{cfg.seed}:{epoch}:{i}".encode()).hexdigest(), i))
    train, valid = (np.flatnonzero(split == s).tolist() for s in ("train", "valid"))
    n_t, dim = Y.shape[1], X.shape[1]
    W, b = np.random.default_rng(cfg.seed).standard_normal((n_t, dim)) * cfg.init_scale, np.zeros(n_t)
    m, v, t = [np.zeros_like(W), np.zeros_like(b)], [np.zeros_like(W), np.zeros_like(b)], 0
    best, hist = None, []
    cut = lambda ids: [ids[k:k + cfg.batch_size] for k in range(0, len(ids), cfg.batch_size)]
    score = lambda i: 1 / (1 + np.exp(-(X[i] @ W.T + b)))
    for epoch in range(cfg.epochs):
        batches, losses = cut(order(train, epoch)), []
        for lo in range(0, len(batches), cfg.batches_per_pass):
            grads = []
            for i in batches[lo:lo + cfg.batches_per_pass]:
                P = score(i)
                Z = 2 * (P - Y[i]) * P * (1 - P) / (len(i) * n_t)
                grads.append((Z.T @ X[i], Z.sum(axis=0)))
                losses.append(((P - Y[i]) ** 2).mean())
            for g in grads:
                t += 1
                for k, p in enumerate((W, b)):
                    m[k] = cfg.beta1 * m[k] + (1 - cfg.beta1) * g[k]
                    v[k] = cfg.beta2 * v[k] + (1 - cfg.beta2) * g[k] ** 2
                    p -= cfg.lr * (m[k] / (1 - cfg.beta1 ** t)) / (np.sqrt(v[k] / (1 - cfg.beta2 ** t)) + cfg.eps)
        val = np.mean([((score(i) - Y[i]) ** 2).mean() for i in cut(valid)])
        hist.append((epoch, np.mean(losses), val))
        if best is None or val < best[0]:
            best = (val, W.copy(), b.copy(), epoch)
        if epoch - best[3] >= cfg.patience:
            break
    return best, hist


@pytest.mark.parametrize("per_pass", [1, 3])
def test_steps_equal_a_plain_loop(spark, per_pass):
    X, Y, split = data()
    cfg = MinibatchConfig(lr=0.05, epochs=3, batch_size=50, batches_per_pass=per_pass, traits=["a", "b"])
    scorer, hist = fit_minibatch(frame(spark, X, Y, split), cfg)
    best, want = plain(X, Y, split, cfg)
    got = [(r["epoch"], r["train_loss"], r["val_loss"]) for r in hist.orderBy("epoch").collect()]
    assert np.allclose(got, want)
    assert np.allclose(scorer.weights, best[1]) and np.allclose(scorer.bias, best[2]) and scorer.best_epoch == best[3]
    assert got[-1][2] < got[0][2]


def test_early_stop_and_errors(spark):
    X, Y, split = data(n=60)
    Y = np.where((split == "valid")[:, None], 1 - Y, Y)  # validation rows contradict training rows
    scorer, hist = fit_minibatch(frame(spark, X, Y, split), MinibatchConfig(lr=0.5, epochs=30, patience=2, batch_size=10, traits=["a", "b"]))
    assert hist.count() == scorer.best_epoch + 3
    with pytest.raises(ValueError, match="no training rows"):
        fit_minibatch(frame(spark, X, Y, split).where("split = 'test'"))


def test_train_batches_are_a_global_md5_order(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as essay_id", "if(id % 3 = 0, 'valid', 'train') as split").repartition(5)
    want = {}
    for s in ("train", "valid"):
        ids = sorted((i for i in range(3000) if (i % 3 == 0) == (s == "valid")),
                     key=lambda i: hashlib.md5(f"42:4:{i}".encode()).hexdigest())
        want |= {i: k // 128 for k, i in enumerate(ids)}
    for rows in (4096, 100, 7):
        monkeypatch.setattr(H, "CELL_ROWS", rows)
        assert {r.essay_id: r.batch for r in H.train_batch_ids(df, 128, epoch=4).collect()} == want


@pytest.mark.parametrize("segment", [1, 4000])
def test_segments_hand_the_steps_on(spark, monkeypatch, segment):
    X, Y, split = data()
    cfg = MinibatchConfig(lr=0.05, epochs=2, batch_size=30, batches_per_pass=2, traits=["a", "b"])
    monkeypatch.setattr("kappaflow.operators.minibatch.SEGMENT_BYTES", segment)
    scorer, hist = fit_minibatch(frame(spark, X, Y, split), cfg)
    best, want = plain(X, Y, split, cfg)
    assert np.allclose([(r["epoch"], r["train_loss"], r["val_loss"]) for r in hist.orderBy("epoch").collect()], want)
    assert np.allclose(scorer.weights, best[1]) and np.allclose(scorer.bias, best[2]) and scorer.best_epoch == best[3]


def test_jobs_do_not_grow_with_the_passes(spark):
    X, Y, split = data()
    jobs = []
    for size in (240, 2):  # one pass, then 120
        spark.sparkContext.setJobGroup(f"passes-{size}", "fit")
        fit_minibatch(frame(spark, X, Y, split), MinibatchConfig(epochs=1, batch_size=size, batches_per_pass=1, traits=["a", "b"]))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes-{size}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 5
