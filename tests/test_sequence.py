import numpy as np
import pytest
from pyspark.sql import functions as F

from kappaflow.operators import sequence as S


def _vectors(spark, lens, dim=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(e, "train" if e % 3 else "test", p, [float(x) for x in rng.standard_normal(dim).astype(np.float32)])
            for e, n in enumerate(lens) for p in range(n)]
    return spark.createDataFrame(rows, "essay_id long, split string, pos int, embedding array<float>"), rows


def test_offsets_assign_roundtrip(spark):
    lens = [3, 1, 5, 2, 7, 1, 4]
    vec, rows = _vectors(spark, lens)
    counts = vec.groupBy("essay_id", "split").agg(F.count(F.lit(1)).cast("int").alias("n_sentences"))
    off = S.sentence_offsets(counts)
    per_split = {}
    for r in off.collect():
        per_split.setdefault(r.split, []).append((r.essay_id, r.start, r.n_sentences))
    for s, items in per_split.items():
        items.sort()
        last = items[-1]
        assert last[1] + last[2] == sum(n for _, _, n in items)
    positional = S.positional_rows(vec, off)
    assert positional.columns == ["split", "row", "embedding"]
    back = S.assign_by_offset(positional, off)
    got = sorted((r.essay_id, r.pos, tuple(r.embedding)) for r in back.collect())
    exp = sorted((e, p, tuple(v)) for e, _, p, v in rows)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in exp]
    assert all(np.allclose(x[2], y[2]) for x, y in zip(got, exp))


def test_sequences_pad_and_pool(spark):
    lens = [3, 1, 5]
    vec, rows = _vectors(spark, lens, dim=3)
    seqs = S.essay_sequences(vec)
    by_id = {r.essay_id: r for r in seqs.collect()}
    for e, n in enumerate(lens):
        exp = [v for ee, _, p, v in sorted(rows, key=lambda x: (x[0], x[2])) if ee == e]
        assert by_id[e].seq_len == n
        assert np.allclose(by_id[e].sequence, exp)
    padded = {r.essay_id: r for r in S.pad_sequences(seqs, length=5).collect()}
    assert all(len(r.padded) == 5 for r in padded.values())
    assert padded[1].padded[1:] == [[0.0] * 3] * 4 and padded[1].seq_len == 1
    pooled = {r.essay_id: r for r in S.pool_sequences(vec).collect()}
    for e in range(3):
        m = np.array([v for ee, _, _, v in rows if ee == e], dtype=np.float64)
        assert np.allclose(pooled[e].mean, m.mean(0), atol=1e-9)
        assert np.allclose(pooled[e].max, m.max(0))
        assert np.allclose(pooled[e].first, m[0]) and np.allclose(pooled[e].last, m[-1])


def test_pooling_hot_essay_is_partial_aggregated(spark):
    vec, _ = _vectors(spark, [2000, 3, 3], dim=2)
    plan = S.pooled_features(vec.repartition(4)).select("features")._jdf.queryExecution().executedPlan().toString()
    assert "partial" in plan.lower() or "Partial" in plan
    f = {r.essay_id: r.features.toArray() for r in S.pooled_features(vec).collect()}
    assert len(f) == 3 and f[0].shape == (2,)


def test_pad_lengths_are_equal_and_nothing_is_cut(spark):
    vec, _ = _vectors(spark, [2, 6, 3], dim=2)
    seqs = S.essay_sequences(vec)
    splits = {r.essay_id: r.split for r in seqs.collect()}
    longest = {}
    for e, n in enumerate([2, 6, 3]):
        longest[splits[e]] = max(longest.get(splits[e], 0), n)
    assert {r.essay_id: len(r.padded) for r in S.pad_sequences(seqs).collect()} == {e: longest[splits[e]] for e in range(3)}
    assert {len(r.padded) for r in S.pad_sequences(seqs, length=9).collect()} == {9}
    with pytest.raises(Exception, match="longer than 4"):
        S.pad_sequences(seqs, length=4).collect()
    with pytest.raises(ValueError):
        S.pooled_features(vec, "median")


def test_merge_carries_essays_over_ranges(spark):
    lens = [40, 1, 0, 25, 3]
    off = spark.createDataFrame([(e, "train", s, n) for e, s, n in zip(range(5), [0, 40, 41, 41, 66], lens)],
                                "essay_id long, split string, start long, n_sentences int")
    rows = spark.range(75).selectExpr("'train' as split", "id as row", "concat('v', id) as essay_id_text")
    want = [(r, e, r - s) for e, s, n in zip(range(5), [0, 40, 41, 41, 66], lens) for r in range(s, s + n)]
    for parts in (1, 7, 30):
        got = S.assign_by_offset(rows, off, num_partitions=parts)
        assert sorted((r.row, r.essay_id, r.pos) for r in got.collect()) == want
        assert {r.essay_id_text for r in got.collect()} == {f"v{r}" for r, _, _ in want}
    assert S.assign_by_offset(rows.limit(0), off).count() == 0 and S.assign_by_offset(rows, off.limit(0)).count() == 0
