import numpy as np
import pandas as pd

from kappaflow.operators.ordering import row_index, running_offset


def test_running_offset_matches_pandas_with_skew(spark):
    rng = np.random.default_rng(1)
    n = 5000
    split = np.where(rng.random(n) < 0.7, "train", np.where(rng.random(n) < 0.5, "valid", "test"))
    pdf = pd.DataFrame({"essay_id": rng.permutation(n), "split": split, "w": rng.integers(0, 9, n)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = running_offset(df, ["essay_id"], ["split"], weight="w", out="start", num_partitions=11).toPandas()
    exp = pdf.sort_values(["split", "essay_id"]).copy()
    exp["start"] = exp.groupby("split")["w"].cumsum() - exp["w"]
    m = got.merge(exp, on=["essay_id", "split"], suffixes=("", "_e"))
    assert len(m) == n and (m["start"] == m["start_e"]).all()


def test_row_index_without_groups(spark):
    df = spark.range(0, 3000).selectExpr("id * 7 % 3001 as k")
    got = row_index(df, ["k"], [], num_partitions=5).toPandas().sort_values("k")
    assert list(got["row_index"]) == list(range(3000))


def test_spread_only_rebalances_too_few_splits(spark):
    from kappaflow.sources.fixtures import spread
    target = spark.sparkContext.defaultParallelism
    one = spark.range(0, 1000, numPartitions=1)
    many = spark.range(0, 1000, numPartitions=target * 2)
    assert spread(one, "id").rdd.getNumPartitions() == target
    assert spread(many, "id") is many
    assert sorted(r.id for r in spread(one, "id").collect()) == list(range(1000))
