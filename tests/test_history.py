import math

import numpy as np
import pytest

from kappaflow.operators import history as H


def loop_rule(vals, patience):
    """The training loop's own rule, as plain Python."""
    best, p, best_epoch = float("inf"), patience, None
    for ep, v in enumerate(vals):
        if v < best:
            best, p, best_epoch = v, patience, ep
        else:
            p -= 1
            if p == 0:
                return ep, best_epoch, ep + 1
    return None, best_epoch, len(vals)


def test_early_stopping_matches_loop(spark):
    rng = np.random.default_rng(5)
    runs = {}
    for r in range(30):
        n = int(rng.integers(5, 60))
        v = 1.0 / (np.arange(n) + 2) + rng.integers(0, 11, n) / 100.0
        if r == 0:
            v = np.full(n, 0.5)                      # tie after first epoch: no improvement
        if r == 1:
            v = np.array([math.nan] + [0.3] * (n - 1))  # NaN never improves
        runs[r] = [float(x) for x in v]
    rows = [(r, e, v) for r, vals in runs.items() for e, v in enumerate(vals)]
    hist = spark.createDataFrame(rows, "run_id long, epoch long, val_loss double")
    got = {r.run_id: r for r in H.early_stopping(hist, patience=4).collect()}
    for r, vals in runs.items():
        stop, best, n_run = loop_rule(vals, 4)
        assert got[r].stop_epoch == stop, r
        assert got[r].best_epoch == best, r
        assert got[r].epochs_run == n_run, r
        assert got[r].stopped_early == (stop is not None)


def test_short_last_batch_weighs_fully(spark):
    essays = spark.createDataFrame([(i, "test") for i in range(130)], "essay_id long, split string")
    batches = H.eval_batch_ids(essays, 128)
    sizes = sorted((r.batch, r["count"]) for r in batches.groupBy("batch").count().collect())
    assert sizes == [(0, 128), (1, 2)]
    # error 0 in batch 0, error 1 (pred 1, label 0) in the 2-row batch
    preds = spark.createDataFrame([(i, "test", 1.0 if i >= 128 else 0.0, 0, 0) for i in range(130)],
                                  "essay_id long, split string, pred01 double, r1 int, r2 int")
    r = H.mse_batch_mean(preds, batches, ["split"]).first()
    assert r.n_batches == 2 and r.loss == pytest.approx(0.5)
    assert H.mse_loss(preds, ["split"]).first().mse == pytest.approx(2 / 130, abs=1e-9)


def test_train_batches_are_seeded_and_complete(spark):
    essays = spark.createDataFrame([(i, "train") for i in range(1000)], "essay_id long, split string")
    a = {r.essay_id: r.batch for r in H.train_batch_ids(essays, 128, epoch=0).collect()}
    b = {r.essay_id: r.batch for r in H.train_batch_ids(essays.repartition(5), 128, epoch=0).collect()}
    c = {r.essay_id: r.batch for r in H.train_batch_ids(essays, 128, epoch=1).collect()}
    assert a == b and a != c
    counts = np.bincount(list(a.values()))
    assert list(counts) == [128] * 7 + [104]


def test_running_loss(spark, monkeypatch):
    rows = [(0, 0, b, float(b)) for b in range(25)] + [(1, 0, b, 1.0) for b in range(25)]
    df = spark.createDataFrame(rows, "run_id long, epoch long, batch long, loss double")
    for block in (1000, 1):  # reports of one epoch in one block and in many
        monkeypatch.setattr(H, "REPORTS_PER_BLOCK", block)
        got = [(r.run_id, r.batch, r.running_loss) for r in H.running_loss(df).orderBy("run_id", "batch").collect()]
        assert got == [(0, 9, 4.5), (0, 19, 9.5), (1, 9, 1.0), (1, 19, 1.0)]


@pytest.mark.parametrize("bad", [math.nan, math.inf, 5e7])
def test_no_loss_hides_a_bad_value(spark, bad):
    p = spark.createDataFrame([(1, "s", 0.6, 3, 3), (2, "s", bad, 3, 3), (3, "s", 0.6, None, 3)],
                              "essay_id long, split string, pred01 double, r1 int, r2 int")
    want = ((bad - 0.6) ** 2) / 2
    r = H.mse_loss(p, ["split"]).first()
    batches = spark.createDataFrame([(i, "s", 0) for i in (1, 2, 3)], "essay_id long, split string, batch long")
    m = H.mse_batch_mean(p, batches, ["split"]).first()
    assert r.n == 2
    for got in (r.mse, m.loss):
        assert got == pytest.approx(want, nan_ok=True)
    b = spark.createDataFrame([(0, 0, i, bad if i == 4 else 0.5) for i in range(10)], "run_id long, epoch long, batch long, loss double")
    assert H.running_loss(b).first().running_loss == pytest.approx((4.5 + bad) / 10, nan_ok=True)
    e = spark.createDataFrame([("a", 0.5), ("a", bad)], "k string, accuracy double")
    assert H.experiment_mean(e, ["k"], ["accuracy"]).first().accuracy_mean == pytest.approx((0.5 + bad) / 2, nan_ok=True)
