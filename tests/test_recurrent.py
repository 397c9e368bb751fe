import numpy as np
import pytest
from pyspark.sql import functions as F

from kappaflow.operators import recurrent as R
from kappaflow.operators import sequence as S


def gru(seed, dim, width):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=s) * 0.5 for s in ((3 * width, dim), (3 * width, width), (3 * width,), (3 * width,))]


def plain_gru(w, x):
    """Gate by gate, one essay at once."""
    w_ih, w_hh, b_ih, b_hh = w
    n = w_hh.shape[1]
    h, out = np.zeros(n), []
    sig = lambda v: 1 / (1 + np.exp(-v))
    for v in x:
        r = sig(w_ih[:n] @ v + b_ih[:n] + w_hh[:n] @ h + b_hh[:n])
        z = sig(w_ih[n:2 * n] @ v + b_ih[n:2 * n] + w_hh[n:2 * n] @ h + b_hh[n:2 * n])
        c = np.tanh(w_ih[2 * n:] @ v + b_ih[2 * n:] + r * (w_hh[2 * n:] @ h + b_hh[2 * n:]))
        h = (1 - z) * c + z * h
        out.append(h)
    return np.array(out)


def essays(spark, lens, dim=3, seed=0):
    rng = np.random.default_rng(seed)
    x = {e: rng.normal(size=(n, dim)) for e, n in enumerate(lens)}
    rows = [(e, "train" if e % 2 else "test", p, v.tolist()) for e, m in x.items() for p, v in enumerate(m)]
    return x, spark.createDataFrame(rows, "essay_id long, split string, pos int, embedding array<double>").repartition(5)


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_two_layers_of_both_directions_equal_a_plain_loop(spark, chunk):
    x, vec = essays(spark, [1, 2, 4, 5, 9, 30, 3])
    w = [(gru(1, 3, 4), gru(2, 3, 4)), (gru(3, 8, 2), gru(4, 8, 2))]
    layers = [tuple((lambda a=a: R.GRUCell(*a)) for a in pair) for pair in w]
    chunks = S.chunked_sequences(vec, chunk)
    assert chunks.agg(F.max(F.size("vectors"))).first()[0] <= chunk
    got = {r.essay_id: r for r in R.final_states(R.bidirectional(chunks, layers)).collect()}
    for e, m in x.items():
        for fwd, bwd in w:
            m = np.concatenate([plain_gru(fwd, m), plain_gru(bwd, m[::-1])[::-1]], axis=1)
        assert got[e].seq_len == len(m) and np.allclose(got[e].features.toArray(), m[-1])


def test_a_very_long_essay_stays_in_small_rows(spark):
    n = 30_000
    vec = spark.range(n).selectExpr("7L as essay_id", "'train' as split", "cast(id as int) as pos",
                                    "array(cast(id % 5 as double), 1D) as embedding")
    vec = vec.unionByName(spark.createDataFrame([(8, "train", 0, [2.0, 2.0])], vec.schema))
    chunks = S.chunked_sequences(vec)
    out = R.layer(chunks, lambda: R.DecayCell(2))
    assert out.agg(F.max(F.size("vectors")), F.sum("n")).first()[:] == (64, n + 1)
    got = {r.essay_id: r for r in R.final_states(out).collect()}
    h = np.zeros(2)
    for p in range(n):
        h = 0.5 * h + 0.5 * np.array([p % 5, 1.0])
    assert got[7].seq_len == n and np.allclose(got[7].features.toArray(), h)
    assert np.allclose(got[8].features.toArray(), [1.0, 1.0])


def test_length_batches_bound_padding_and_bytes(spark):
    lens = list(range(1, 300)) + [5] * 50 + [1000]
    df = spark.createDataFrame([(i, "train" if i % 3 else "test", n) for i, n in enumerate(lens)], "essay_id long, split string, seq_len int")
    rows = S.length_batches(df, dim=4, batch_bytes=4096).collect()
    assert len(rows) == len(lens)
    batches = {}
    for r in rows:
        assert r.seq_len <= r.padded_len and (r.padded_len - r.seq_len) / r.padded_len < 0.2
        batches.setdefault((r.split, r.padded_len, r.batch), []).append(r.essay_id)
    for (_, length, _), ids in batches.items():
        assert len(ids) == 1 or len(ids) * length * 16 <= 4096
    report = S.padding_report(S.length_batches(df, dim=4, batch_bytes=4096)).collect()
    assert sum(r.n_essays for r in report) == len(lens) and sum(r.n_batches for r in report) == len(batches)
    assert sum(r.positions for r in report) == sum(lens) and all(r.padding_share < 0.2 for r in report)


def test_padded_chunks(spark):
    x, vec = essays(spark, [1, 3, 9, 17], dim=2)
    batches = S.length_batches(vec.groupBy("essay_id", "split").agg(F.count(F.lit(1)).alias("seq_len")), dim=2)
    rows = S.pad_batch_chunks(S.chunked_sequences(vec, 4), batches, 4).orderBy("essay_id", "chunk").collect()
    for e, m in x.items():
        parts = [r for r in rows if r.essay_id == e]
        whole = [v for r in parts for v in r.vectors]
        assert max(len(r.vectors) for r in parts) <= 4 and sum(r.n for r in parts) == len(m)
        assert len(whole) == parts[0].padded_len >= len(m)
        assert np.allclose(whole[:len(m)], m) and not np.any(whole[len(m):])


def test_nothing_to_read(spark):
    _, vec = essays(spark, [2])
    empty = S.chunked_sequences(vec.limit(0))
    assert R.final_states(R.layer(empty, lambda: R.DecayCell(3))).count() == 0
