from kappaflow.operators import report as R


def test_high_error_pairs_runs_like_full_outer_join(spark):
    rows = [(e, "test", "kobert", exp, "task_1", p, 0, 0)
            for exp, preds in ((0, [0.9, 0.1, 0.5]), (1, [0.0, 0.8, 0.6]))
            for e, p in enumerate(preds)]
    preds = spark.createDataFrame(rows, "essay_id long, split string, variant string, exp int, trait string, "
                                        "pred01 double, r1 int, r2 int")
    got = {r.essay_id: r for r in R.high_error(preds, ["split", "variant", "trait"], "exp", 0, 1, k=2).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0].prev_rank, got[0].cur_rank) == (1, None)
    assert (got[1].prev_rank, got[1].cur_rank) == (None, 1)
    assert (got[2].prev_rank, got[2].cur_rank) == (2, 2)
    assert got[0].prev_err == 0.9 and got[1].cur_err == 0.8


def test_regression_delta_flags_and_one_sided_rows(spark):
    rows = [("r1", "accuracy", 0, 0.50), ("r1", "accuracy", 1, 0.52), ("r1", "qwk", 0, 0.40),
            ("r1", "qwk", 1, 0.405), ("r1", "mae", 1, 0.9)]
    m = spark.createDataFrame(rows, "rater string, metric string, exp int, value double")
    got = {r.metric: r for r in R.regression_delta(m, ["rater"], "exp", 0, 1, 0.01).collect()}
    assert got["accuracy"].flagged and abs(got["accuracy"].delta - 0.02) < 1e-12
    assert not got["qwk"].flagged
    assert got["mae"].baseline is None and got["mae"].delta is None


def test_score_distribution_fills_empty_buckets(spark):
    rows = [(i, "g", p) for i, p in enumerate([0.0, 0.0, 0.5, 1.0])]
    preds = spark.createDataFrame(rows, "essay_id long, g string, pred01 double")
    got = {r.pred: (r.n, r.share) for r in R.score_distribution(preds, ["g"]).collect()}
    assert got == {0: (2, 0.5), 1: (0, 0.0), 2: (1, 0.25), 3: (0, 0.0), 4: (0, 0.0), 5: (1, 0.25)}
