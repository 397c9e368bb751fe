"""Hard negatives against brute force; the bounds and what they spare."""

import math
from collections import Counter

import numpy as np
import pytest

from kappaflow.llm import hard_negatives as hn
from kappaflow.llm.queries import QUERIES


def brute(rows, every=50, scale=256, dim=8, relabel=False):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(x * scale) for x in v]
        if max(map(abs, q)) <= hn.MOST:
            if relabel and i % 7 == 0:
                label = (label + 1) % 10
            best[i] = min(best.get(i, (label, np.array(q, "<i4").tobytes(), q)), (label, np.array(q, "<i4").tobytes(), q))
    out = Counter()
    for a, (la, _, qa) in best.items():
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(qa, q)), i, l) for i, (l, _, q) in best.items() if i != a))
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            for r, (t, n, _) in enumerate(fits):
                out[a, p, r + 1, n, -s, -t] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "s") for r in rows],
                                 "vec_id long, embedding array<double>, label int, chunk int, part int, s string")


def rows_of(seed=0, n=700, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    rows = [(i, (centre[i % 4] * (i % 3) + rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    hot = rng.normal(size=dim).tolist()
    rows += [(5_000 + i, hot, i % 2) for i in range(350)]  # ties
    rows += [(9_000, [0.0] * dim, 1), (9_001, [float("nan")] * dim, 1), (9_002, [float("inf")] * dim, 1), (9_003, None, 1),
             (9_004, [1.0], 1), (9_005, [None] * dim, 1), (9_006, hot, None), (None, hot, 1), (9_050, [1e30] * dim, 1),
             (9_100, [-x for x in hot], 77), (50, hot, 3), (9_051, [300.0] * dim, 2), (9_150, [-300.0] * dim, 2)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_mine(spark, monkeypatch, small):
    if small:
        for name, v in (("ANCHOR_CHUNK", 5), ("GROUP_ROWS", 60)):
            monkeypatch.setattr(hn, name, v)
    rows = rows_of()
    got = hn.mine(table(spark, rows), "vec_id % 50 = 0", dim=8)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert hn.mine(table(spark, rows[:0]), "vec_id % 50 = 0", dim=8).count() == 0
    assert hn.mine(table(spark, rows), "vec_id < 0", dim=8).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 3, 7, 64, 100])
def test_bounds_hold_and_tighten(dim):
    rng = np.random.default_rng(dim)
    x, y = (np.floor(rng.normal(size=(40, dim)) * 10 ** rng.uniform(0, 6, size=(40, 1))) for _ in "xy")
    ids = np.arange(40)
    a, b = (hn.Rows(ids, ids, v, hn.summaries(v, dim), dim) for v in (x, y))
    score, last = x @ y.T, np.inf
    for ma, da, mb, db in zip(a.mean, a.dev, b.mean, b.dev):
        mid, off = ma @ mb.T, da @ db.T
        assert (np.abs(score - mid) <= off).all()
        assert off.sum() <= last * (1 + 1e-9)
        last = off.sum()
    assert (hn.exact_scores(a, b, ids, ids) == [sum(int(p) * int(q) for p, q in zip(u, v)) for u, v in zip(x, y)]).all()
    big = np.full((1, dim), float(hn.MOST))
    r = hn.Rows(ids[:1], ids[:1], big, hn.summaries(big, dim), dim)
    assert hn.exact_scores(r, r, ids[:1], ids[:1])[0] == hn.MOST ** 2 * dim


def spared(x, label, k, bands=None):
    """Share of pairs that each level leaves, for the first 40 rows as anchors."""
    dim = x.shape[1]
    rows = hn.Rows(np.arange(len(x)), label, x, hn.summaries(x, dim), dim)
    a = rows.part(0, 40)
    low = np.full((40, 1), hn.NONE)
    best = hn.Best(low, -(low + 1), k) if bands is None else hn.Best(*bands, k)
    alive = [0] * (len(hn.levels(dim)) + 1)
    hn.search(a, best, rows, bands is None, alive)
    return best, [n / alive[0] for n in alive]


def test_filter_drops_most_pairs():
    rng = np.random.default_rng(3)
    label = np.zeros(20_000, dtype=np.int64)
    flat = rng.normal(size=(20_000, 64))
    flat = np.floor(256 * flat / np.linalg.norm(flat, axis=1, keepdims=True))
    best, left = spared(flat, label, 5)
    score = flat[:40] @ flat.T
    np.fill_diagonal(score, -1e9)
    assert (np.sort(score, axis=1)[:, -5] == best.score[:, -1]).all()
    assert left[-1] < 0.35  # directions without any structure: only the finest level drops (measured: 0.31)
    smooth = np.cumsum(rng.normal(size=(20_000, 64)), axis=1)
    smooth = np.floor(256 * smooth / np.linalg.norm(smooth, axis=1, keepdims=True))
    _, left = spared(smooth, label, 5)
    assert left[1] < 0.7 and left[2] < 0.1 and left[-1] < 0.02


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = Counter(map(tuple, QUERIES["op11_hard_negatives"](spark, sf).collect()))
    assert got == brute(rows, dim=64, relabel=True)
