import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kappaflow.operators.checks import MissingColumnsError, invalid_utf8_lines, missing_columns
from kappaflow.schema import PROMPT_COL, RATER1_COLS, RATER2_COLS, REQUIRED_COLUMNS, TEXT_COL, TRAITS
from kappaflow.sources import embeddings as EMB
from kappaflow.sources import essays as ES
from kappaflow.sources import sinks


def _csv(path, rows, header=None, bom=True):
    header = header or REQUIRED_COLUMNS
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def _row(prompt, text, score="3"):
    return [prompt, text] + [score] * 16


def test_essay_csv_bom_quotes_newlines(spark, scratch):
    paths = {}
    for s in ("train", "valid", "test"):
        p = os.path.join(scratch, f"{s}.csv")
        _csv(p, [_row("P1", '"He said ""hi""#@문장구분#second\nline"'), _row("P2", "plain", "5")])
        paths[s] = p
    df = ES.read_essay_splits(spark, paths)
    rows = df.orderBy("split", "essay_id").collect()
    assert len(rows) == 6
    assert df.columns[0] == PROMPT_COL
    assert rows[0][TEXT_COL] == 'He said "hi"#@문장구분#second\nline'
    assert rows[0][RATER1_COLS[0]] == 3 and rows[1][RATER2_COLS[-1]] == 5
    assert df.select("essay_id").distinct().count() == 6
    out = ES.ingest_essays(spark, paths, os.path.join(scratch, "essays"))
    assert out.count() == 6 and set(r.split for r in out.select("split").distinct().collect()) == set(paths)


def test_missing_columns_and_wrong_header(spark, scratch):
    p = os.path.join(scratch, "lfs.csv")
    with open(p, "w") as f:
        f.write("version https://git-lfs.github.com/spec/v1\noid sha256:abc\nsize 1\n")
    lfs = spark.read.option("header", True).csv(p)
    assert missing_columns(lfs) == REQUIRED_COLUMNS
    with pytest.raises(MissingColumnsError):
        ES.read_essay_splits(spark, {"train": p})
    bad = os.path.join(scratch, "bad.csv")
    _csv(bad, [_row("P", "t")], header=[PROMPT_COL, "wrong"] + RATER1_COLS + RATER2_COLS)
    with pytest.raises(MissingColumnsError, match="answer@text"):
        ES.read_essay_csv(spark, bad)


def test_csv_columns_by_name(spark, scratch):
    p = os.path.join(scratch, "x.csv")
    header = ["extra"] + REQUIRED_COLUMNS[::-1] + ["no"]
    _csv(p, [["e"] + _row("P1", "text", "4")[::-1] + ["17"]], header=header)
    r = ES.read_essay_splits(spark, {"train": p}, id_col="no").first()
    assert (r[PROMPT_COL], r[TEXT_COL], r[RATER1_COLS[3]], r["extra"], r["essay_id"]) == ("P1", "text", 4, "e", 17)
    _csv(p, [_row("P1", "text", "four")])
    with pytest.raises(Exception, match="no number"):
        ES.read_essay_csv(spark, p).collect()


def test_invalid_utf8_lines(spark, scratch):
    p = os.path.join(scratch, "raw.csv")
    with open(p, "wb") as f:
        f.write("ok line\n".encode() + b"bad \xff\xfe line\n" + "한국어\n".encode())
    bad = invalid_utf8_lines(spark, p).collect()
    assert len(bad) == 1


def test_embedding_csv_positional_rows(spark, scratch):
    p = os.path.join(scratch, "emb.csv")
    mat = np.arange(40, dtype=np.float32).reshape(10, 4) / 8
    np.savetxt(p, mat, delimiter=",", fmt="%.6f")
    df = EMB.read_embedding_csv(spark, p, 4, split="train")
    got = sorted((r.row, tuple(r.embedding)) for r in df.collect())
    assert [r for r, _ in got] == list(range(10))
    assert np.allclose([e for _, e in got], mat)


def test_embedding_store_is_keyed_and_complete(spark, scratch):
    path = os.path.join(scratch, "emb")
    calls = []

    def rows(n):
        return spark.createDataFrame([(i, "train" if i % 2 else "test", 0, f"s{i}") for i in range(n)],
                                     "essay_id long, split string, pos int, sentence string")

    def job(n, tag="kobert", dim=2, encoder="e", lost=0):
        def build():
            calls.append((n, tag, dim, encoder))
            return rows(n - lost).select(F.lit(tag).alias("variant"), "split", "essay_id", "pos",
                                         F.array_repeat(F.lit(0.5).cast("float"), dim).alias("embedding"))
        return EMB.materialize_embeddings(spark, path, rows(n), build, tag, encoder, dim)

    assert job(4).count() == 4 and job(4).count() == 4 and len(calls) == 1
    assert job(6).count() == 6 and len(calls) == 2          # grown data
    assert job(6, dim=3).first().embedding == [0.5] * 3     # another length
    job(6, tag="labeled_kobert")
    job(6, encoder="f")
    assert len(calls) == 5
    assert EMB.read_embeddings(spark, os.path.join(path, "kobert", os.listdir(os.path.join(path, "kobert"))[0]), "test").count() in (2, 3)
    with pytest.raises(EMB.IncompleteEmbeddingsError):
        job(8, lost=1)
    with pytest.raises(EMB.IncompleteEmbeddingsError):
        job(8)                                              # stored incomplete: still an error


def test_prediction_sink_and_run_record(spark, scratch):
    rows = [(e, "test", "kobert", 0, t, (e + k) / 10.0) for e in range(3) for k, t in enumerate(TRAITS)]
    preds = spark.createDataFrame(rows, "essay_id long, split string, variant string, exp int, trait string, pred01 double")
    wide = sinks.predictions_wide(preds)
    assert wide.columns == ["essay_id", "split", "variant", "exp"] + TRAITS
    r = wide.where("essay_id = 1").first()
    assert r.task_1 == 0 and r.content_1 == 1 and r.content_2 == 2   # 0.5 -> 2 (half even)
    out = os.path.join(scratch, "pred")
    sinks.write_predictions(preds, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 3 and "variant" in back.columns
    runs = os.path.join(scratch, "runs")
    sinks.append_run_record(spark, runs, "r1", "end_to_end", seed=42, settings={"lr": 0.05})
    sinks.append_run_record(spark, runs, "r2", "fine_tune", seed=43)
    got = spark.read.parquet(runs)
    assert sorted(r.run_id for r in got.collect()) == ["r1", "r2"]
    assert got.where(F.col("run_id") == "r1").first().settings == '{"lr": 0.05}'


def test_positional_numbers_move_no_vector(spark, scratch):
    from kappaflow.sources.embeddings import read_embedding_csv
    path = os.path.join(scratch, "emb")
    os.makedirs(path)
    n = 0
    for k, size in enumerate((300, 5, 120)):
        with open(os.path.join(path, f"part-{k}.csv"), "w") as f:
            f.writelines(f"{n + i},{(n + i) * 2}\n" for i in range(size))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_embedding_csv(spark, path, 2, "train")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan and "BroadcastHashJoin" in plan
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.row for r in rows) == list(range(n)) and all(r.embedding == [r.row, r.row * 2] for r in rows)


def test_run_records_are_keyed(spark, scratch):
    path = os.path.join(scratch, "keyed")
    record = lambda run, exp, seed, loss: {"run_id": run, "variant": "kobert", "exp": exp, "seed": seed, "best_val_loss": loss}
    sinks.write_run_records(spark, path, [record("a", 0, 42, 0.5), record("a", 1, 142, 0.4)])
    sinks.write_run_records(spark, path, [record("b", 0, 42, 0.3)])
    sinks.write_run_records(spark, path, [record("a", 0, 42, 0.2)])
    got = {(r.run_id, r.exp): (r.seed, r.best_val_loss) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 0): (42, 0.2), ("a", 1): (142, 0.4), ("b", 0): (42, 0.3)} and spark.read.parquet(path).count() == 3
