"""The corpus pipeline, stage by stage and whole, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

import corpus_pipeline
from kappaflow.llm import importance
from tests.llm.test_documents import brute_components, brute_lines, runs, words

DOC = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("source", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType()),
    ("n_removed", T.StringType()), ("kept", T.StringType()), ("tk", T.LongType()), ("h", T.StringType()))])


def table(spark, rows):
    return spark.createDataFrame([(i, "s", t, len(t or ""), "r", "k", 5, "h") for i, t in rows], DOC)


def made(seed=3):
    """Documents with junk, shared lines, near copies and benchmark passages."""
    rnd = random.Random(seed)
    items = [(i, words(rnd, 25, 3000)) for i in range(6)] + [(6, "rare pair"), (7, None)]
    rows = [(i, "\n".join(words(rnd, rnd.randint(8, 40), 900) for _ in range(rnd.randint(1, 4)))) for i in range(120)]
    shared = words(rnd, 20, 900)
    rows += [(200 + i, words(rnd, 30, 900) + "\n" + shared + "\n" + words(rnd, 30, 900)) for i in range(10)]
    rows += [(300 + i, rows[i][1].replace("w", "w", 1) + " tail") for i in range(10)]
    rows += [(400 + i, " ".join(f"JUNK{rnd.randint(0, 99)}!!" for _ in range(30))) for i in range(25)]
    rows += [(500 + i, words(rnd, 60, 900) + "\n" + items[i % 7][1] + "\n" + words(rnd, 60, 900)) for i in range(14)]
    rows += [(600, None), (601, ""), (602, " \n "), (603, rows[0][1]), (None, words(rnd, 50, 900)), (604, words(rnd, 6_000, 900))]
    rnd.shuffle(rows)
    good = [i for i, _ in rows if i is not None and i < 250]
    return rows, items, good


@pytest.fixture()
def sf_dir(spark, tmp_path):
    rows, items, good = made()
    at = str(tmp_path)
    table(spark, rows).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in good] + [(400, 0), (401, 0)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def brute_quality(rows, good):
    """Weights from models counted text by text, and the rows whose keys
    (weight and Gumbel noise) are the k largest."""
    n = np.full((2, importance.FEATURES), importance.SMOOTHING)
    for i, t in rows:
        c = np.bincount(importance._features([t or ""])[0], minlength=importance.FEATURES)
        n[0] += c
        n[1] += c * (i in good)
    cut = importance.BUCKETS
    ratio = np.concatenate([np.log(n[1][k] / n[1][k].sum()) - np.log(n[0][k] / n[0][k].sum()) for k in (slice(0, cut), slice(cut, None))])
    weight = [ratio[importance._features([t or ""])[0]].sum() for _, t in rows]
    u = [(xxhash.xxh3_64_intdigest(f"{i}\0{t or ''}", seed=importance.SEED) + 0.5) / 2.0**64 for i, t in rows]
    key = [w - np.log(-np.log(x)) for w, x in zip(weight, u)]
    k = sum(w >= importance.LEAST_LOG_WEIGHT for w in weight)
    least = sorted(key, reverse=True)[k - 1]
    return weight, [r for r, x in zip(rows, key) if x >= least]


def test_quality(spark, sf_dir):
    rows, _, good = made()
    d = table(spark, rows)
    out = corpus_pipeline.quality(spark, d, sf_dir)
    assert out.columns == DOC.names
    weight, kept = brute_quality(rows, set(good))
    got = importance.resample(d, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    assert sorted(r["log_weight"] for r in got) == pytest.approx(sorted(weight))
    assert pairs(out) == sorted(kept, key=str) and not any(i and 400 <= i < 500 for i, _ in kept)


def brute_cut(rows):
    """Texts without the lines that repeat an earlier one; documents that lose
    all they hold go."""
    gone = brute_lines(rows, 0.8)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        cut = gone.get((i, t), set())
        if not cut:
            out.append((i, t))
        elif any(x.strip() for k, x in enumerate(lines) if k not in cut):
            out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in cut)))
    return sorted(out, key=str)


def test_lines(spark, sf_dir):
    rows, *_ = made()
    out = corpus_pipeline.lines(spark, table(spark, rows), sf_dir)
    assert out.columns == DOC.names
    assert pairs(out) == brute_cut(rows) and len(brute_cut(rows)) < len(rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def one_of_each(rows):
    return [r for r, (i, _, least) in zip(rows, brute_components(rows)) if i == least]


def test_near_dups(spark, sf_dir):
    rows, *_ = made()
    out = corpus_pipeline.near_dups(spark, table(spark, rows), sf_dir)
    assert out.columns == DOC.names
    want = one_of_each(rows)
    assert pairs(out) == sorted(want, key=str) and len(want) < len(rows)


def holds(text, item):
    m = min(5, len((item or "").split()))
    found = runs(item, m) if m else set()
    return bool(found) and len(found & runs(text, m)) >= len(found) - int(0.25 * len(found) + 1e-9)


def test_benchmark(spark, sf_dir):
    rows, items, _ = made()
    out = corpus_pipeline.benchmark(spark, table(spark, rows), sf_dir)
    want = [(i, t) for i, t in rows if not any(holds(t, q) for _, q in items)]
    assert out.columns == DOC.names and pairs(out) == sorted(want, key=str) and len(want) == len(rows) - 14


def test_run(spark, sf_dir):
    """Each stage works on what the one before kept, and the ids that come out
    decode to the texts of the documents that stay."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    got = corpus_pipeline.run(spark, sf_dir).collect()
    rows, items, good = made()
    rows = one_of_each(brute_cut(brute_quality(rows, set(good))[1]))
    rows = [(i, t) for i, t in rows if not any(holds(t, q) for _, q in items)]
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=str)
    ids = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        piece = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["length"] == len(piece) <= 2048 and r["start"] == len(ids.get(r["doc_id"], []))
        ids.setdefault(r["doc_id"], []).extend(piece)
    assert sorted(ids.items(), key=str) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048


def test_stages_of_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    table(spark, []).write.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table(spark, []), at)
        assert out.columns == DOC.names and out.count() == 0, name
    assert corpus_pipeline.run(spark, at).count() == 0
