import numpy as np
import pytest
from pyspark.sql import functions as F

from kappaflow.operators import metrics as M


def qwk_numpy(a, b, labels=None):
    """Confusion-matrix form, weights on class index (scikit-learn semantics)."""
    a, b = np.asarray(a), np.asarray(b)
    classes = np.union1d(a, b) if labels is None else np.asarray(labels)
    ia, ib = np.searchsorted(classes, a), np.searchsorted(classes, b)
    k = len(classes)
    C = np.zeros((k, k))
    np.add.at(C, (ia, ib), 1)
    i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
    W = (i - j) ** 2
    E = np.outer(C.sum(1), C.sum(0)) / C.sum()
    den = (W * E).sum()
    return None if den == 0 else 1 - (W * C).sum() / den


def _ev(spark, groups):
    rows = [(g, i, int(t), int(p)) for g, (ts, ps) in groups.items() for i, (t, p) in enumerate(zip(ts, ps))]
    return spark.createDataFrame(rows, "g string, essay_id long, yt int, yp int")


def _qwk(spark, groups, labels="present"):
    return {r.g: r.qwk for r in M.qwk(_ev(spark, groups), ["g"], labels).collect()}


def test_qwk_matches_confusion_matrix_form(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g in range(12):
        t = rng.integers(0, 6, 200)
        p = np.clip(t + rng.integers(-2, 3, 200), 0, 5)
        if g % 3 == 0:                      # drop classes to make index != value
            t = np.where(t == 1, 0, t)
            p = np.where(p == 4, 5, p)
        groups[f"g{g}"] = (t, p)
    got = _qwk(spark, groups)
    for g, (t, p) in groups.items():
        assert got[g] == pytest.approx(qwk_numpy(t, p), abs=1e-12)


def test_qwk_index_vs_value_weights(spark):
    t = [0, 2, 3, 5, 0, 2, 3, 5, 2, 3]
    p = [0, 3, 3, 5, 2, 2, 5, 3, 2, 0]
    present = _qwk(spark, {"a": (t, p)})["a"]
    fixed = _qwk(spark, {"a": (t, p)}, "fixed")["a"]
    assert present == pytest.approx(qwk_numpy(t, p), abs=1e-12)
    assert fixed == pytest.approx(qwk_numpy(t, p, labels=range(6)), abs=1e-12)
    assert abs(present - fixed) > 1e-3


def test_qwk_edge_cases(spark):
    got = _qwk(spark, {"one": ([3, 3, 3], [3, 3, 3]), "same": ([0, 1, 2, 5], [0, 1, 2, 5]),
                       "rev": ([0, 1, 2], [2, 1, 0])})
    assert got["one"] is None
    assert got["same"] == 1.0
    assert got["rev"] == pytest.approx(qwk_numpy([0, 1, 2], [2, 1, 0]))
    assert got["rev"] < 0


def test_qwk_properties(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 6, 300)
    p = np.clip(t + rng.integers(-1, 2, 300), 0, 5)
    relabel = {0: 10, 1: 11, 2: 20, 3: 30, 4: 31, 5: 50}   # monotone
    got = _qwk(spark, {"tp": (t, p), "pt": (p, t), "rl": ([relabel[x] for x in t], [relabel[x] for x in p])})
    assert got["tp"] == pytest.approx(got["pt"], abs=1e-15)
    assert got["tp"] == pytest.approx(got["rl"], abs=1e-15)


def test_confusion_sums_to_n_and_accuracy(spark):
    groups = {"a": ([0, 1, 2, 2], [0, 2, 2, 2]), "b": ([5, 5], [4, 5])}
    ev = _ev(spark, groups)
    conf = M.confusion(ev, ["g"]).groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r.g: r.n for r in conf} == {"a": 4, "b": 2}
    acc = {r.g: r.accuracy for r in M.accuracy(ev, ["g"]).collect()}
    assert acc == {"a": 0.75, "b": 0.5}
    mr = {r.g: (r.mae, r.rmse) for r in M.mae_rmse(ev, ["g"]).collect()}
    assert mr["a"] == (0.25, 0.5) and mr["b"] == (0.5, pytest.approx(np.sqrt(0.5)))


def test_metrics_independent_of_partitioning(spark):
    rng = np.random.default_rng(11)
    groups = {f"g{g}": (rng.integers(0, 6, 150), rng.integers(0, 6, 150)) for g in range(6)}
    ev = _ev(spark, groups)
    results = []
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            results.append(sorted(tuple(r) for r in M.agreement(ev.repartition(n), ["g"]).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_rubric_report_levels(spark):
    rows = [("r1", t, i, yt, yp) for t in ("task_1", "content_1") for i, (yt, yp) in
            enumerate([(0, 0), (1, 2), (2, 2), (3, 5)])]
    ev = spark.createDataFrame(rows, "rater string, trait string, essay_id long, yt int, yp int")
    rep = {(r.level, r.trait): r for r in M.rubric_report(ev, ["rater"]).collect()}
    assert set(rep) == {("trait", "task_1"), ("trait", "content_1"), ("overall", "*")}
    assert rep[("overall", "*")].n == 8
    assert rep[("overall", "*")].accuracy == 0.5
    assert rep[("overall", "*")].qwk == pytest.approx(qwk_numpy([0, 1, 2, 3] * 2, [0, 2, 2, 5] * 2))


def test_trait_mean_counts_null_kappa(spark):
    per = spark.createDataFrame([("a", 0.5, 0.2), ("a", 1.0, None)], "g string, accuracy double, qwk double")
    r = M.trait_mean(per, ["g"]).first()
    assert (r.accuracy_mean, r.qwk_mean, r.n_traits, r.n_null_qwk) == (0.75, 0.2, 2, 1)
