from pyspark.sql import functions as F

from kappaflow.functions import text as T
from kappaflow.operators import text as X
from kappaflow.plans.queries import QUERIES
from kappaflow.schema import PROMPT_COL, SENTENCE_SEP, TEXT_COL
from tests.conftest import SF_SMALL


def _essays(spark, rows):
    return spark.createDataFrame(rows, f"essay_id long, split string, `{PROMPT_COL}` string, `{TEXT_COL}` string")


def test_split_edge_cases(spark):
    df = spark.createDataFrame([(1, f"a{SENTENCE_SEP}"), (2, ""), (3, None), (4, f"x{SENTENCE_SEP}y")], "id int, t string")
    got = {r.id: r.s for r in df.select("id", T.split_sentences("t").alias("s")).collect()}
    assert got == {1: ["a", ""], 2: [""], 3: None, 4: ["x", "y"]}


def test_separator_is_literal(spark):
    df = spark.createDataFrame([("a.b|c",)], "t string")
    assert df.select(T.split_sentences("t", "|").alias("s")).first().s == ["a.b", "c"]
    assert df.select(T.split_sentences("t", ".").alias("s")).first().s == ["a", "b|c"]


def test_prompt_modes(spark):
    e = _essays(spark, [(1, "train", "P", f"s1{SENTENCE_SEP}s2")])
    got = {m: X.sentences(e, m).first().sentences for m in ("none", "labeled", "fine_tune", "prompt_first")}
    assert got["none"] == ["s1", "s2"]
    assert got["labeled"] == ["P###s1", "P###s2"]
    assert got["fine_tune"] == ["P#s1", "P#s2"]
    assert got["prompt_first"] == ["prompt:P", "s1", "s2"]


def test_cap_129_keeps_128(spark):
    text = SENTENCE_SEP.join(f"s{i}" for i in range(129))
    e = _essays(spark, [(1, "train", "P", text), (2, "train", "P", "one")])
    s = {r.essay_id: r.sentences for r in X.sentences(e, max_sentences=128).collect()}
    assert len(s[1]) == 128 and s[1][-1] == "s127" and s[2] == ["one"]


def test_cap_is_an_argument_only(spark):
    text = SENTENCE_SEP.join(f"s{i}" for i in range(200))
    e = _essays(spark, [(1, "train", "P", text), (2, "train", "P", text), (3, "test", "P", text)])
    assert {len(r.sentences) for r in X.sentences(e, max_sentences=3).collect()} == {3}
    assert {len(r.sentences) for r in X.sentences(e).collect()} == {200}


def test_query_caps_at_128_only(spark):
    rows = QUERIES["sentence_cap"](spark, SF_SMALL).collect()
    whole = {r.essay_id: r.sentences for r in QUERIES["sentences"](spark, SF_SMALL).collect()}
    assert len(rows) == len(whole) + 1
    assert any(r.n_sentences > 128 for r in rows) and any(3 < r.n_sentences <= 128 for r in rows)
    for r in rows:
        assert r.n_kept == len(r.sentences) == min(r.n_sentences, 128)
        assert r.sentences == whole.get(r.essay_id, [f"sentence {i}" for i in range(1, 201)])[:128]


def test_sentence_rows_keep_order_and_regroup(spark):
    e = _essays(spark, [(i, "train", "P", SENTENCE_SEP.join(f"e{i}s{j}" for j in range(i + 1))) for i in range(20)])
    s = X.sentences(e)
    rows = X.sentence_rows(s)
    back = rows.groupBy("essay_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("x"))
    back = {r.essay_id: [x.sentence for x in r.x] for r in back.collect()}
    assert back == {r.essay_id: r.sentences for r in s.collect()}


def test_token_pad_and_mask(spark):
    rows = spark.createDataFrame([(1, "t", 0, "a b  c"), (2, "t", 0, ""), (3, "t", 0, " ".join(["w"] * 60))],
                                 "essay_id long, split string, pos int, sentence string")
    got = {r.essay_id: r for r in X.tokenize(rows, 6).collect()}
    assert [len(got[i].input_ids) for i in (1, 2, 3)] == [6, 6, 6]
    assert got[1].input_ids[0] == 2 and got[1].input_ids[4] == 3 and got[1].input_ids[5] == 1
    assert got[1].attention_mask == [1, 1, 1, 1, 1, 0]
    assert got[2].input_ids == [2, 3, 1, 1, 1, 1] and got[2].attention_mask == [1, 1, 0, 0, 0, 0]
    assert got[3].input_ids[-1] == 3 and got[3].attention_mask == [1] * 6


def test_first_prompts_count_rows_not_prompts(spark):
    rows = [(i, "train", "A" if i < 4 else f"P{i}", "x") for i in range(10)] + [(100, "test", "P4", "x"),
                                                                              (101, "test", "P9", "x")]
    e = _essays(spark, rows)
    prompts = sorted(r.prompt for r in X.first_prompt(e, 5).collect())
    assert prompts == ["A", "P4"]
    kept = sorted(r.essay_id for r in X.filter_by_prompts(e, X.first_prompt(e, 5)).collect())
    assert kept == [0, 1, 2, 3, 4, 100]


def test_variant_fanout(spark):
    e = _essays(spark, [(1, "train", "P", f"a{SENTENCE_SEP}b")])
    got = {r.variant: (r.with_prompt, r.sentences) for r in X.variant_fanout(e).collect()}
    assert got == {"kobert": (False, ["a", "b"]), "labeled_kobert": (True, ["P###a", "P###b"])}


def test_quarantine_keeps_bad_rows_with_reason(spark):
    from kappaflow.operators.checks import quarantine, quarantine_counts
    from kappaflow.schema import RATER1_COLS, RATER2_COLS
    cols = ", ".join(f"`{c}` int" for c in RATER1_COLS + RATER2_COLS)
    ok = [3] * 16
    rows = [(1, "train", "P", "a", *ok), (2, "train", "P", None, *ok),
            (3, "test", "P", "b", *([7] + ok[1:])), (4, "test", None, None, *([None] + ok[1:]))]
    e = spark.createDataFrame(rows, f"essay_id long, split string, `{PROMPT_COL}` string, `{TEXT_COL}` string, {cols}")
    good, bad = quarantine(e)
    assert [r.essay_id for r in good.collect()] == [1]
    reasons = {r.essay_id: r.reason for r in bad.collect()}
    assert reasons == {2: "null_text", 3: "score_out_of_domain", 4: "null_text;null_prompt;null_score"}
    counts = {r.split: (r.n_rows, r.n_quarantined) for r in quarantine_counts(e).collect()}
    assert counts == {"train": (2, 1), "test": (2, 2)}
