from kappaflow.functions.scores import display_round, label01, loss_kind, loss_value, score_int, stable_round, to_unit, truncate_int


def test_half_even_and_clip(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.7,), (0.9,), (1.2,), (-0.3,), (float("nan"),), (float("inf"),), (None,)],
                               "p double")
    assert [r.s for r in df.select(score_int("p").alias("s")).collect()] == [0, 2, 2, 4, 4, 5, 0, None, 5, None]


def test_label_and_truncation(spark):
    df = spark.createDataFrame([(3, 4, 4.9), (0, 5, -1.5)], "a int, b int, x double")
    r = df.select(label01("a", "b").alias("l"), truncate_int("x").alias("t"), display_round("x", 0).alias("d")).collect()
    assert [x.l for x in r] == [0.7, 0.5]
    assert [x.t for x in r] == [4, -1]
    assert [x.d for x in r] == [5.0, -2.0]


def test_to_unit_and_rounding(spark):
    df = spark.createDataFrame([(5, 0.1), (2, 0.2), (0, 0.3)], "s int, x double")
    assert [r.u for r in df.select(to_unit("s").alias("u")).collect()] == [1.0, 0.4, 0.0]
    r = spark.createDataFrame([(0.0082890625,), (-0.0000000015,), (float("nan"),)], "x double")
    got = [row.r for row in r.select(stable_round("x").alias("r")).collect()]
    assert got[0] == 0.008289063 and got[1] == -0.000000001 and got[2] != got[2]


def test_loss_value_hides_nothing(spark):
    rows = [(0.25,), (float("nan"),), (float("inf"),), (2.5e15,), (None,)]
    r = spark.createDataFrame(rows, "x double").select(loss_kind("x").alias("k"), loss_value("x").alias("v")).collect()
    assert [(x.k, x.v) for x in r] == [("finite", 0.25), ("nan", None), ("inf", None), ("finite", 2.5e15), (None, None)]
