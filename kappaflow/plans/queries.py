"""Registered queries: one Spark plan per operator, each with its DuckDB twin.

Every query reads the shared tables under ``sf_dir`` (or views Spark derives
from them) in full.  ``QUERIES[name]`` is ``(spark, sf_dir) -> DataFrame``;
``ORACLE[name]`` is the equivalent DuckDB SQL over the raw tables, absent for
operators no SQL engine can express (model fits, Spark-ML hashing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.operators import checks as C
from kappaflow.operators import history as H
from kappaflow.operators import labels as L
from kappaflow.operators import metrics as M
from kappaflow.operators import recurrent as RNN
from kappaflow.operators.ordering import row_index
from kappaflow.operators import report as R
from kappaflow.operators import sequence as S
from kappaflow.operators import text as X
from kappaflow.plans import oracle as O
from kappaflow.schema import (BASE_SEED, MAX_SENTENCES, MAX_TOKENS_LABELED, MAX_TOKENS_RAW, PATIENCE, PROMPT_COL, RATER1_COLS,
                              RATER2_COLS, SENTENCE_BATCH, SPLITS, TEXT_COL, TRAITS, q)
from kappaflow.functions.scores import label01, loss_kind, loss_kind_sql, loss_value, loss_value_sql, stable_round
from kappaflow.functions.scores import stable_round_sql as SR
from kappaflow.functions.text import split_sentences
from kappaflow.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RUN = ["split", "variant", "exp"]
RUN_T = RUN + ["trait"]
EVAL_BATCH = 128       # essays per evaluation batch (end_to_end / fine_tune loaders)
TOP_K = 10
DELTA_TOLERANCE = 0.01


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ shared views

def _essays(spark, d):
    return FX.essays(spark, d)


def _scores(spark, d):
    return L.scores_long(_essays(spark, d))


def _preds(spark, d):
    return FX.predictions_from_scores(_scores(spark, d))


def _ev(spark, d, keys=RUN_T):
    return L.evaluation_rows(_preds(spark, d), keys)


def _sentences(spark, d, **kw):
    return X.sentences(_essays(spark, d), **kw)


def _sentence_vectors(spark, d):
    rows = X.sentence_rows(_sentences(spark, d))
    emb = FX.table(spark, d, "embeddings")
    return FX.sentence_vectors(rows, emb, emb.count())


def _offsets(spark, d):
    return S.sentence_offsets(X.sentence_counts(_sentences(spark, d)))


# ------------------------------------------------------------------ SQL helpers

P = O.prediction_ctes()
EV = P + O.ev_ctes()
K_RUN_T = ", ".join(RUN_T)


def _acc_select(keys, src="ev"):
    k = ", ".join(keys)
    return (f"SELECT {k}, count(*) AS n, CAST(sum(CASE WHEN yt = yp THEN 1 ELSE 0 END) AS DOUBLE) "
            f"/ CAST(count(*) AS DOUBLE) AS accuracy FROM {src} WHERE yt IS NOT NULL AND yp IS NOT NULL GROUP BY {k}")


def _qwk_ctes(keys, p: str, labels: str = "present", src: str = "ev"):
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    ctes = [(f"{p}_conf", f"SELECT {k}, yt, yp, count(*) AS n FROM {src} "
                         f"WHERE yt IS NOT NULL AND yp IS NOT NULL GROUP BY {k}, yt, yp")]
    if labels == "present":
        ctes += [
            (f"{p}_cls", f"SELECT {k}, yt AS c FROM {p}_conf UNION SELECT {k}, yp AS c FROM {p}_conf"),
            (f"{p}_ix", f"SELECT {k}, c, dense_rank() OVER (PARTITION BY {k} ORDER BY c) - 1 AS ix FROM {p}_cls"),
            (f"{p}_cw", f"SELECT f.*, a.ix AS i, b.ix AS j FROM {p}_conf f "
                       f"JOIN {p}_ix a ON {on('a', 'f')} AND a.c = f.yt JOIN {p}_ix b ON {on('b', 'f')} AND b.c = f.yp")]
    else:
        ctes += [(f"{p}_cw", f"SELECT *, yt AS i, yp AS j FROM {p}_conf")]
    ctes += [
        (f"{p}_s", f"SELECT {k}, CAST(sum(n) AS HUGEINT) AS n, CAST(sum(n * (i - j) * (i - j)) AS HUGEINT) AS d2, "
                  f"CAST(sum(n * i * i) AS HUGEINT) AS i2, CAST(sum(n * j * j) AS HUGEINT) AS j2, "
                  f"CAST(sum(n * i) AS HUGEINT) AS si, CAST(sum(n * j) AS HUGEINT) AS sj FROM {p}_cw GROUP BY {k}"),
        (f"{p}_qwk", f"SELECT {k}, CASE WHEN n * (i2 + j2) - si * sj * 2 = 0 THEN NULL ELSE "
                    f"CAST(1 AS DOUBLE) - CAST(n * d2 AS DOUBLE) / CAST(n * (i2 + j2) - si * sj * 2 AS DOUBLE) END AS qwk "
                    f"FROM {p}_s")]
    return ctes


def _agreement_ctes(keys, p: str, labels="present"):
    k = ", ".join(keys)
    return _qwk_ctes(keys, p, labels) + [
        (f"{p}_acc", _acc_select(keys)),
        (f"{p}_agr", f"SELECT a.*, q.qwk FROM {p}_acc a JOIN {p}_qwk q USING ({k})")]


# ================================================================== A: sources

@register("essays_by_split", O.with_(O.essays_cte(), select="SELECT * FROM essays"))
def essays_by_split(spark, d):
    """A1/A2: the essay table, all splits in one frame tagged by ``split``."""
    return _essays(spark, d)


@register("predictions_wide", O.with_(*EV, select=(
        "SELECT essay_id, split, variant, exp, "
        + ", ".join(f"max(CASE WHEN trait = '{t}' THEN yp END) AS {t}" for t in TRAITS)
        + " FROM pe GROUP BY essay_id, split, variant, exp")))
def predictions_wide(spark, d):
    """Long integer predictions -> one row per essay with 8 trait columns."""
    p = L.predicted_scores(_preds(spark, d))
    return p.groupBy("essay_id", "split", "variant", "exp").pivot("trait", TRAITS).agg(F.max("pred"))


# ================================================================== B: checks

@register("split_sizes", O.with_(O.essays_cte(), select="SELECT split, count(*) AS n_essays FROM essays GROUP BY split"))
def split_sizes(spark, d):
    return C.split_sizes(_essays(spark, d))


@register("utf8_check", O.with_(O.essays_cte(), select=(
        f"SELECT split, count(*) AS n_rows, count(*) FILTER (essay_id % {FX.DEFECT_EVERY} = 11) AS n_invalid_utf8 "
        "FROM essays GROUP BY split")))
def utf8_check(spark, d):
    """B3 on a table in which one text of 50 ends in bytes that are not UTF-8
    (DuckDB holds no such text, so its twin counts the essays that get them)."""
    return C.utf8_report(FX.defective(_essays(spark, d)), [PROMPT_COL, TEXT_COL])


def _fingerprint_sql():
    cols = [O.qi(c) for c in ("essay_id", PROMPT_COL, TEXT_COL, *RATER1_COLS, *RATER2_COLS)]
    whole = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols)
    return O.with_(O.essays_cte(), select=(
        f"SELECT split, count(*) AS n_rows, CAST(sum(('0x' || substr(md5({whole}), 1, 15))::BIGINT) AS VARCHAR) AS fingerprint "
        "FROM essays GROUP BY split"))


@register("split_fingerprint", _fingerprint_sql())
def split_fingerprint(spark, d):
    """Revision fingerprint per split."""
    return C.split_fingerprint(_essays(spark, d))


@register("score_domain", O.with_(O.essays_cte(), O.defective_cte(), ("long", "\nUNION ALL\n".join(
        f"SELECT split, '{c}' AS \"column\", CAST({O.qi(c)} AS DOUBLE) AS value FROM defective"
        for c in [f"rater{r}@{t}" for r in (1, 2) for t in TRAITS])), select=(
        "SELECT split, \"column\", count(*) AS n, "
        "CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
        "CAST(sum(CASE WHEN value IS NOT NULL AND (value < 0 OR value > 5 OR value <> floor(value)) THEN 1 ELSE 0 END) "
        "AS BIGINT) AS n_out_of_domain FROM long GROUP BY split, \"column\"")))
def score_domain(spark, d):
    """B6 on scores of which some are missing or too large."""
    return C.score_domain(FX.defective(_essays(spark, d)))


@register("embedding_alignment", O.with_(*O.sentence_vector_ctes(), O.misaligned_cte(), select=(
        "SELECT split, CAST(sum(CASE WHEN a.pos IS NOT NULL AND b.pos IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_matched, "
        "CAST(sum(CASE WHEN b.pos IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_sentence_only, "
        "CAST(sum(CASE WHEN a.pos IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_vector_only "
        "FROM (SELECT essay_id, split, pos FROM srows) a FULL OUTER JOIN (SELECT essay_id, split, pos FROM mis) b "
        "USING (essay_id, split, pos) GROUP BY split")))
def embedding_alignment(spark, d):
    """B4 on vectors of which one in 97 has lost its sentence."""
    rows = X.sentence_rows(_sentences(spark, d))
    return C.embedding_alignment(rows, FX.misaligned(_sentence_vectors(spark, d)))


def _quarantine_sql():
    scores = [O.qi(f"rater{r}@{t}") for r in (1, 2) for t in TRAITS]
    bad = " OR ".join(f"{c} IS NULL OR {c} < 0 OR {c} > 5" for c in scores)
    return O.with_(O.essays_cte(), O.defective_cte(), select=(
        "SELECT split, count(*) AS n_rows, CAST(sum(CASE WHEN \"answer@text\" IS NULL OR \"question@prompt\" IS NULL "
        f"OR {bad} THEN 1 ELSE 0 END) AS BIGINT) AS n_quarantined FROM defective GROUP BY split"))


@register("quarantine_counts", _quarantine_sql())
def quarantine_counts(spark, d):
    """Rows per split and how many go to quarantine (NULL text / prompt / score, score outside 0..5)."""
    return C.quarantine_counts(FX.defective(_essays(spark, d)))


# ================================================================== C: projections / filters

@register("scores_long", O.with_(O.essays_cte(), O.scores_cte(), select="SELECT * FROM scores"))
def scores_long(spark, d):
    return _scores(spark, d)


@register("trait_labels", O.with_(O.essays_cte(), O.scores_cte(), select=(
        "SELECT *, (CAST(r1 + r2 AS DOUBLE) / CAST(2 AS DOUBLE)) / CAST(5 AS DOUBLE) AS label FROM scores")))
def trait_labels(spark, d):
    return L.trait_labels(_scores(spark, d))


def _first_prompts_sql(n):
    return O.with_(O.essays_cte(), (
        "fp", f"SELECT DISTINCT prompt FROM (SELECT \"question@prompt\" AS prompt FROM essays "
              f"WHERE split = 'train' ORDER BY essay_id LIMIT {n}) t"),
        select="SELECT essay_id, split, \"question@prompt\" AS prompt FROM essays "
               "WHERE \"question@prompt\" IN (SELECT prompt FROM fp)")


def _filtered(spark, d, n):
    e = _essays(spark, d)
    return X.filter_by_prompts(e, X.first_prompt(e, n))


@register("filter_first_prompt", _first_prompts_sql(1))
def filter_first_prompt(spark, d):
    """Essays (all splits) on the prompt of the first training essay."""
    return _filtered(spark, d, 1).select("essay_id", "split", F.col(q(PROMPT_COL)).alias("prompt"))


@register("filter_first_prompts", _first_prompts_sql(5))
def filter_first_prompts(spark, d):
    """Essays on the prompts of the first five training rows."""
    return _filtered(spark, d, 5).select("essay_id", "split", F.col(q(PROMPT_COL)).alias("prompt"))


@register("renumbered_rows", O.with_(O.essays_cte(), (
        "fp", "SELECT DISTINCT prompt FROM (SELECT \"question@prompt\" AS prompt FROM essays "
              "WHERE split = 'train' ORDER BY essay_id LIMIT 5) t"),
        select="SELECT essay_id, split, row_number() OVER (PARTITION BY split ORDER BY essay_id) - 1 AS row "
               "FROM essays WHERE \"question@prompt\" IN (SELECT prompt FROM fp)"))
def renumbered_rows(spark, d):
    """Dense row numbers per split after the prompt filter."""
    return X.renumber(_filtered(spark, d, 5).select("essay_id", "split"))


@register("variant_fanout", O.with_(*O.sentences_ctes(), select=(
        "SELECT essay_id, split, 'kobert' AS variant, false AS with_prompt, sentences FROM sent UNION ALL "
        "SELECT essay_id, split, 'labeled_kobert', true, list_transform(sentences, lambda s: prompt || '###' || s) "
        "FROM sent")))
def variant_fanout(spark, d):
    """One row per (essay, variant)."""
    return X.variant_fanout(_essays(spark, d))


# ================================================================== D: text

def _sent_sql(expr):
    return O.with_(*O.sentences_ctes(), select=f"SELECT essay_id, split, {expr} AS sentences FROM sent")


@register("sentences", _sent_sql("sentences"))
def sentences(spark, d):
    """Split on the literal separator, keeping empty pieces."""
    return _sentences(spark, d)


@register("sentences_labeled", _sent_sql("list_transform(sentences, lambda s: prompt || '###' || s)"))
def sentences_labeled(spark, d):
    """Every sentence prefixed ``<prompt>###``."""
    return _sentences(spark, d, mode="labeled")


@register("sentences_fine_tune", _sent_sql("list_transform(sentences, lambda s: prompt || '#' || s)"))
def sentences_fine_tune(spark, d):
    """D3: every sentence prefixed ``<prompt>#``."""
    return _sentences(spark, d, mode="fine_tune")


@register("sentences_prompt_first", _sent_sql("list_concat(['prompt:' || prompt], sentences)"))
def sentences_prompt_first(spark, d):
    """``prompt:<prompt>`` as an extra first sentence."""
    return _sentences(spark, d, mode="prompt_first")


@register("sentence_cap", O.with_(*O.sentences_ctes(), O.long_essay_cte(), select=(
        f"SELECT essay_id, split, CAST(len(sentences) AS INTEGER) AS n_sentences, "
        f"CAST(len(list_slice(sentences, 1, {MAX_SENTENCES})) AS INTEGER) AS n_kept, "
        f"list_slice(sentences, 1, {MAX_SENTENCES}) AS sentences FROM with_long")))
def sentence_cap(spark, d):
    """At most 128 sentences per essay, by the operator's argument."""
    e = FX.with_long_essay(_essays(spark, d))
    e = e.withColumn("n_sentences", F.size(split_sentences(F.col(q(TEXT_COL)))))
    s = X.sentences(e, keys=("essay_id", "split", "n_sentences"), max_sentences=MAX_SENTENCES)
    return s.select("essay_id", "split", "n_sentences", F.size("sentences").alias("n_kept"), "sentences")


@register("sentence_rows", O.with_(*O.sentences_ctes(), select="SELECT * FROM srows"))
def sentence_rows(spark, d):
    """One row per sentence with its position."""
    return X.sentence_rows(_sentences(spark, d))


@register("sentence_counts", O.with_(*O.sentences_ctes(), select=(
        "SELECT essay_id, split, CAST(len(sentences) AS INTEGER) AS n_sentences FROM sent")))
def sentence_counts(spark, d):
    """Sentences per essay."""
    return X.sentence_counts(_sentences(spark, d))


def _token_sql(max_len, labeled):
    sent = "prompt || '###' || sentence" if labeled else "sentence"
    src = ("SELECT r.essay_id, r.split, r.pos, s.prompt, r.sentence FROM srows r JOIN sent s USING (essay_id, split)"
           if labeled else "SELECT * FROM srows")
    ids = O.hash_ids_sql(sent)
    return O.with_(*O.sentences_ctes(), ("tr", src), ("tk", f"SELECT essay_id, split, pos, {ids} AS ids FROM tr"),
                   select=(f"SELECT essay_id, split, pos, "
                           f"list_resize(list_concat([2], list_slice(ids, 1, {max_len - 2}), [3]), {max_len}, 1) AS input_ids, "
                           f"list_transform(range(1, {max_len + 1}), lambda i: CASE WHEN i <= least(len(ids) + 2, {max_len}) "
                           f"THEN 1 ELSE 0 END) AS attention_mask FROM tk"))


@register("token_pad", _token_sql(MAX_TOKENS_RAW, False))
def token_pad(spark, d):
    """D8 + D9: token ids framed, truncated and padded to 50, with the mask."""
    return X.tokenize(X.sentence_rows(_sentences(spark, d)), MAX_TOKENS_RAW)


@register("token_pad_labeled", _token_sql(MAX_TOKENS_LABELED, True))
def token_pad_labeled(spark, d):
    """D8 + D9 for prompt-labeled sentences (length 70)."""
    rows = X.sentence_rows(_sentences(spark, d, mode="labeled"))
    return X.tokenize(rows, MAX_TOKENS_LABELED)


# ================================================================== E: sequences

OFFSETS_SQL = ("off", "SELECT essay_id, split, n_sentences, CAST(coalesce(sum(n_sentences) OVER (PARTITION BY split "
                      "ORDER BY essay_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start "
                      "FROM (SELECT essay_id, split, CAST(len(sentences) AS INTEGER) AS n_sentences FROM sent) c")


@register("sentence_offsets", O.with_(*O.sentences_ctes(), OFFSETS_SQL, select="SELECT * FROM off"))
def sentence_offsets(spark, d):
    """(start, len) of every essay in a positional file, per split."""
    return _offsets(spark, d)


@register("assign_by_offset", O.with_(*O.sentences_ctes(), OFFSETS_SQL, (
        "posr", "SELECT unnest(['train', 'valid', 'test']) AS split, row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding FROM embeddings"),
        select="SELECT p.split, CAST(row AS BIGINT) AS row, essay_id, CAST(row - start AS INTEGER) AS pos, "
               "CAST(embedding AS DOUBLE[]) AS embedding FROM posr p JOIN off o ON p.split = o.split AND row >= start AND row < start + n_sentences"))
def assign_by_offset(spark, d):
    """E5: ``embeddings`` as the positional file of each split; its rows get
    the essay and position that the offsets give them."""
    file = row_index(FX.table(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], out="row")
    positional = file.select(F.explode(F.array(*map(F.lit, SPLITS))).alias("split"), "row",
                             F.col("embedding").cast("array<double>").alias("embedding"))
    return S.assign_by_offset(positional, _offsets(spark, d)).select("split", "row", "essay_id", "pos", "embedding")


@register("essay_sequences", O.with_(*O.sentence_vector_ctes(), select=(
        "SELECT essay_id, split, CAST(count(*) AS INTEGER) AS seq_len, "
        "list(CAST(embedding AS DOUBLE[]) ORDER BY pos) AS sequence FROM sv GROUP BY essay_id, split")))
def essay_sequences(spark, d):
    """Ordered vector sequence per essay."""
    return S.essay_sequences(_sentence_vectors(spark, d))


@register("essay_chunks", O.with_(*O.sentence_vector_ctes(), select=(
        f"SELECT essay_id, split, CAST(pos // {S.SEQUENCE_CHUNK} AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n, "
        "list(CAST(embedding AS DOUBLE[]) ORDER BY pos) AS vectors FROM sv GROUP BY ALL")))
def essay_chunks(spark, d):
    """Sequences in rows of at most 64 vectors."""
    return S.chunked_sequences(_sentence_vectors(spark, d))


BATCH_BYTES = 64 << 10
_STEP = "(CAST(1 AS BIGINT) << greatest(length(bin(greatest(n_sentences - 1, 0))) - 3, 0))"
LENGTH_BATCH_CTES = [
    ("ct", "SELECT essay_id, split, CAST(len(sentences) AS BIGINT) AS n_sentences FROM sent"),
    ("pl", f"SELECT *, CAST(CASE WHEN n_sentences <= 4 THEN greatest(n_sentences, 1) ELSE ((n_sentences + {_STEP} - 1) // {_STEP}) * {_STEP} END "
           "AS BIGINT) AS padded_len FROM ct"),
    ("lb", "SELECT essay_id, split, n_sentences, padded_len, CAST((row_number() OVER (PARTITION BY split, padded_len ORDER BY essay_id) - 1) "
           f"// greatest({BATCH_BYTES} // (padded_len * 256), 1) AS BIGINT) AS batch FROM pl")]


def _length_batches(spark, d):
    return S.length_batches(X.sentence_counts(_sentences(spark, d)), 64, BATCH_BYTES, length_col="n_sentences")


@register("length_batches", O.with_(*O.sentences_ctes(), *LENGTH_BATCH_CTES, select="SELECT * FROM lb"))
def length_batches(spark, d):
    """Essays dealt to batches of one padded length, bounded in bytes."""
    return _length_batches(spark, d)


@register("padding_report", O.with_(*O.sentences_ctes(), *LENGTH_BATCH_CTES, select=(
        "SELECT split, padded_len, count(*) AS n_essays, max(batch) + 1 AS n_batches, CAST(sum(n_sentences) AS BIGINT) AS positions, "
        "CAST(sum(padded_len) AS BIGINT) AS padded_positions, " + SR("CAST(sum(padded_len) - sum(n_sentences) AS DOUBLE) / CAST(sum(padded_len) AS DOUBLE)")
        + " AS padding_share FROM lb GROUP BY split, padded_len")))
def padding_report(spark, d):
    """What the batches' padding costs."""
    r = S.padding_report(_length_batches(spark, d), length_col="n_sentences")
    return r.withColumn("padding_share", stable_round("padding_share"))


@register("recurrent_features", O.with_(*O.sentence_vector_ctes(), (
        "ln", "SELECT essay_id, split, count(*) AS n FROM sv GROUP BY ALL"), (
        "tm", "SELECT essay_id, split, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) "
              "* pow(CAST(0.5 AS DOUBLE), n - pos) AS v FROM sv JOIN ln USING (essay_id, split)"), (
        "sm", "SELECT essay_id, split, dim, sum(v) AS v FROM tm GROUP BY ALL"),
        select=("SELECT essay_id, split, CAST(n AS BIGINT) AS seq_len, features FROM (SELECT essay_id, split, "
                f"list({SR('v', 6)} ORDER BY dim) AS features FROM sm GROUP BY ALL) JOIN ln USING (essay_id, split)")))
def recurrent_features(spark, d):
    """F2 / E8 with a sequence model: a recurrent cell over every essay's
    chunks, its state carried along; the output at the last position."""
    cell = lambda: RNN.DecayCell(64)
    out = RNN.final_states(RNN.layer(S.chunked_sequences(_sentence_vectors(spark, d)), cell))
    return out.withColumn("features", F.transform(vector_to_array("features"), lambda x: stable_round(x, 6)))


BATCH_SQL = ("bt", f"SELECT essay_id, split, CAST((row_number() OVER (PARTITION BY split ORDER BY essay_id) - 1) "
                   f"// {EVAL_BATCH} AS BIGINT) AS batch FROM essays")


@register("pad_sequences", O.with_(*O.sentence_vector_ctes(), (
        "sq", "SELECT essay_id, split, CAST(count(*) AS INTEGER) AS seq_len, "
              "list(CAST(embedding AS DOUBLE[]) ORDER BY pos) AS sequence FROM sv GROUP BY essay_id, split"),
        (BATCH_SQL[0], BATCH_SQL[1]),
        ("ln", "SELECT *, max(seq_len) OVER (PARTITION BY split, batch) AS len FROM sq JOIN bt USING (essay_id, split)"),
        select=("SELECT essay_id, split, seq_len, list_resize(sequence, len, "
                "list_transform(range(len(sequence[1])), lambda x: CAST(0 AS DOUBLE))) AS padded FROM ln")))
def pad_sequences(spark, d):
    """Zero vectors up to the longest essay of the evaluation batch, true length kept."""
    seqs = S.essay_sequences(_sentence_vectors(spark, d)).join(
        H.eval_batch_ids(_essays(spark, d), EVAL_BATCH), ["essay_id", "split"])
    return S.pad_sequences(seqs, by=("split", "batch"))


@register("pool_sequences", O.with_(*O.sentence_vector_ctes(), (
        "dv", "SELECT essay_id, split, unnest(range(len(embedding))) AS dim, "
              "CAST(unnest(embedding) AS DOUBLE) AS v FROM sv"),
        ("pd", f"SELECT essay_id, split, list({SR('m')} ORDER BY dim) AS mean, "
               "list(x ORDER BY dim) AS max FROM (SELECT essay_id, split, dim, avg(v) AS m, max(v) AS x "
               "FROM dv GROUP BY essay_id, split, dim) g GROUP BY essay_id, split"),
        ("fl", "SELECT essay_id, split, count(*) AS n, CAST(arg_min(embedding, pos) AS DOUBLE[]) AS first, "
               "CAST(arg_max(embedding, pos) AS DOUBLE[]) AS last FROM sv GROUP BY essay_id, split"),
        select="SELECT fl.essay_id, fl.split, fl.n, pd.mean, pd.max, fl.first, fl.last FROM fl JOIN pd USING (essay_id, split)"))
def pool_sequences(spark, d):
    """Mean / max / first / last pooling of each essay's vectors."""
    p = S.pool_sequences(_sentence_vectors(spark, d))
    p = p.withColumns({c: vector_to_array(c) for c in S.POOLS})
    return p.withColumn("mean", F.transform("mean", lambda x: stable_round(x)))


_LABEL = "(CAST(r1 + r2 AS DOUBLE) / CAST(2 AS DOUBLE)) / CAST(5 AS DOUBLE)"


@register("mse_loss", O.with_(*P, O.spoiled_cte(), select=(
        f"SELECT split, variant, exp, n, {loss_value_sql('mse')} AS mse, {loss_kind_sql('mse')} AS kind FROM ("
        f"SELECT split, variant, exp, count(e) AS n, avg(e * e) AS mse "
        f"FROM (SELECT *, pred01 - {_LABEL} AS e FROM spoiled) t GROUP BY split, variant, exp) x")))
def mse_loss(spark, d):
    """MSE of 0..1 predictions against the rater-mean label, over runs that
    hold NaN, infinite and huge predictions and missing ratings."""
    return _loss(H.mse_loss(FX.spoiled(_preds(spark, d)), RUN), "mse")


def _loss(df, c):
    return df.withColumn("kind", loss_kind(c)).withColumn(c, loss_value(c))


@register("batch_ids", O.with_(O.essays_cte(), BATCH_SQL, select="SELECT * FROM bt"))
def batch_ids(spark, d):
    """evaluation batches of 128 essays in essay_id order per split."""
    return H.eval_batch_ids(_essays(spark, d), EVAL_BATCH)


@register("train_batch_ids", O.with_(O.essays_cte(), select=(
        "SELECT essay_id, split, CAST(0 AS INTEGER) AS epoch, CAST((row_number() OVER (PARTITION BY split "
        f"ORDER BY md5('{BASE_SEED}:0:' || essay_id), essay_id) - 1) // {EVAL_BATCH} AS BIGINT) AS batch FROM essays")))
def train_batch_ids(spark, d):
    """F4 + F9: seeded per-epoch shuffle into batches."""
    return H.train_batch_ids(_essays(spark, d), EVAL_BATCH, epoch=0)


MSE_BATCH_SQL = [BATCH_SQL, (
    "pb", f"SELECT split, variant, exp, batch, avg(e * e) AS bm FROM (SELECT p.*, b.batch, p.pred01 - {_LABEL} AS e "
          f"FROM {{src}} p JOIN bt b USING (essay_id, split)) t GROUP BY split, variant, exp, batch"), (
    "mb", "SELECT split, variant, exp, count(*) AS n_batches, avg(bm) AS loss "
          "FROM pb GROUP BY split, variant, exp")]


def _batch_sql(src):
    return [(name, sql.replace("{src}", src)) for name, sql in MSE_BATCH_SQL]


@register("mse_batch_mean", O.with_(*P, O.spoiled_cte(), *_batch_sql("spoiled"), select=(
        f"SELECT split, variant, exp, n_batches, {loss_value_sql('loss')} AS loss, {loss_kind_sql('loss')} AS kind FROM mb")))
def mse_batch_mean(spark, d):
    """F3 as reported by the loop: mean of per-batch MSE (batches of 128)."""
    e = _essays(spark, d)
    preds = FX.spoiled(FX.predictions_from_scores(L.scores_long(e)))
    return _loss(H.mse_batch_mean(preds, H.eval_batch_ids(e, EVAL_BATCH), RUN), "loss")


@register("running_loss", O.with_(O.batch_losses_cte(), (
        "rl", "SELECT run_id, epoch, batch, sum(loss) OVER w / count(loss) OVER w AS running_loss FROM batch_losses "
              "WINDOW w AS (PARTITION BY run_id, epoch ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
              "QUALIFY (batch + 1) % 10 = 0"), select=(
        f"SELECT run_id, epoch, batch, {loss_value_sql('running_loss')} AS running_loss, "
        f"{loss_kind_sql('running_loss')} AS kind FROM rl")))
def running_loss(spark, d):
    """running train loss reported every 10 batches, per run and epoch;
    some batches have a NaN, infinite, huge or missing loss."""
    return _loss(H.running_loss(FX.batch_losses(spark, d)), "running_loss")


STOP_SQL = [
    ("hx", "SELECT run_id, variant, exp, epoch, val_loss, val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id "
           "ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS improved FROM history"),
    ("hy", "SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS stale FROM hx"),
    ("hs", f"SELECT run_id, min(CASE WHEN stale >= {PATIENCE} THEN epoch END) AS stop_epoch FROM hy GROUP BY run_id"),
    ("stop", "SELECT run_id, variant, exp, count(*) AS epochs_run, max(stop_epoch) AS stop_epoch, "
             "max(CASE WHEN improved THEN epoch END) AS best_epoch, min(CASE WHEN improved THEN val_loss END) "
             "AS best_val_loss, max(stop_epoch) IS NOT NULL AS stopped_early FROM hy JOIN hs USING (run_id) "
             "WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run_id, variant, exp")]


@register("early_stopping", O.with_(O.history_cte(), *STOP_SQL, select="SELECT * FROM stop"))
def early_stopping(spark, d):
    """F6 + F7: stop epoch (patience 10), best epoch and its val loss per run."""
    return H.early_stopping(FX.history(spark, d), PATIENCE, ["run_id", "variant", "exp"])


@register("best_epoch", O.with_(O.history_cte(), *STOP_SQL,
                                select="SELECT run_id, variant, exp, best_epoch, best_val_loss FROM stop"))
def best_epoch(spark, d):
    """the checkpoint to reload before testing."""
    return early_stopping(spark, d).select("run_id", "variant", "exp", "best_epoch", "best_val_loss")


@register("experiment_mean", O.with_(*EV, *_agreement_ctes(RUN_T + ["rater"], "a"), select=(
        f"SELECT split, variant, trait, rater, count(*) AS n_exp, {SR('avg(accuracy)')} AS accuracy_mean, "
        f"{SR('avg(qwk)')} AS qwk_mean FROM a_agr GROUP BY split, variant, trait, rater")))
def experiment_mean(spark, d):
    """F8: metrics averaged over repeated experiments."""
    per = M.agreement(_ev(spark, d), RUN_T + ["rater"])
    return _rounded(H.experiment_mean(per, ["split", "variant", "trait", "rater"]), "accuracy_mean", "qwk_mean")


def _rounded(df, *cols):
    """Means of doubles, whose last bits depend on the summation order."""
    return df.withColumns({c: stable_round(c) for c in cols})


# ================================================================== G: scores

@register("predicted_scores", O.with_(*EV, select=(
        "SELECT essay_id, split, variant, exp, trait, pred01, yp AS pred FROM pe")))
def predicted_scores(spark, d):
    """G1 + G2: half-even rounding of pred01 * 5, clipped to 0..5."""
    return L.predicted_scores(_preds(spark, d)).select("essay_id", "split", "variant", "exp", "trait", "pred01", "pred")


# ================================================================== I: metrics

@register("accuracy_by_trait", O.with_(*EV, select=_acc_select(RUN_T + ["rater"])))
def accuracy_by_trait(spark, d):
    """I1 (+ I6): accuracy per trait against each rater."""
    return M.accuracy(_ev(spark, d), RUN_T + ["rater"])


@register("qwk_by_trait", O.with_(*EV, *_qwk_ctes(RUN_T + ["rater"], "k"), select="SELECT * FROM k_qwk"))
def qwk_by_trait(spark, d):
    """I2 (+ I6): index-weighted QWK per trait against each rater."""
    return M.qwk(_ev(spark, d), RUN_T + ["rater"])


@register("qwk_by_trait_fixed", O.with_(*EV, *_qwk_ctes(RUN_T + ["rater"], "k", "fixed"), select="SELECT * FROM k_qwk"))
def qwk_by_trait_fixed(spark, d):
    """I2 with value weights over the fixed 0..5 scale."""
    return M.qwk(_ev(spark, d), RUN_T + ["rater"], labels="fixed")


@register("agreement_by_trait", O.with_(*EV, *_agreement_ctes(RUN_T + ["rater"], "a"), select="SELECT * FROM a_agr"))
def agreement_by_trait(spark, d):
    """I1 + I2: the flagship report - per trait and rater, n, accuracy and QWK."""
    return M.agreement(_ev(spark, d), RUN_T + ["rater"])


@register("overall_metrics", O.with_(*EV, *_agreement_ctes(RUN + ["rater"], "o"), select="SELECT * FROM o_agr"))
def overall_metrics(spark, d):
    """Accuracy and QWK on all traits pooled."""
    return M.agreement(_ev(spark, d), RUN + ["rater"])


@register("trait_mean_metrics", O.with_(*EV, *_agreement_ctes(RUN_T + ["rater"], "a"), select=(
        f"SELECT split, variant, exp, rater, {SR('avg(accuracy)')} AS accuracy_mean, "
        f"{SR('avg(qwk)')} AS qwk_mean, count(*) AS n_traits, "
        f"CAST(sum(CASE WHEN qwk IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_qwk FROM a_agr "
        f"GROUP BY split, variant, exp, rater")))
def trait_mean_metrics(spark, d):
    """I4: mean over the 8 traits (differs from the pooled I3)."""
    return M.trait_mean(M.agreement(_ev(spark, d), RUN_T + ["rater"]), RUN + ["rater"])


@register("confusion", O.with_(*EV, select=(
        f"SELECT {K_RUN_T}, rater, yt, yp, count(*) AS n FROM ev WHERE yt IS NOT NULL AND yp IS NOT NULL "
        f"GROUP BY {K_RUN_T}, rater, yt, yp")))
def confusion(spark, d):
    """Truth x prediction counts."""
    return M.confusion(_ev(spark, d), RUN_T + ["rater"])


@register("mae_rmse", O.with_(*EV, select=(
        f"SELECT {K_RUN_T}, rater, count(*) AS n, CAST(sum(abs(yt - yp)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mae, "
        f"sqrt(CAST(sum((yt - yp) * (yt - yp)) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS rmse FROM ev "
        f"WHERE yt IS NOT NULL AND yp IS NOT NULL GROUP BY {K_RUN_T}, rater")))
def mae_rmse(spark, d):
    """I7 + I8 per trait and rater on integer scores."""
    return M.mae_rmse(_ev(spark, d), RUN_T + ["rater"])


def _rubric_sql_ctes():
    keys = RUN + ["rater"]
    k = ", ".join(keys)
    add = (f"SELECT {k}, CASE WHEN grouping(trait) = 1 THEN 'overall' ELSE 'trait' END AS level, "
           f"CASE WHEN grouping(trait) = 1 THEN '*' ELSE trait END AS trait, count(*) AS n, "
           f"CAST(sum(CASE WHEN yt = yp THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS accuracy, "
           f"CAST(sum(abs(yt - yp)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mae, "
           f"sqrt(CAST(sum((yt - yp) * (yt - yp)) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS rmse "
           f"FROM ev WHERE yt IS NOT NULL AND yp IS NOT NULL GROUP BY GROUPING SETS (({k}, trait), ({k}))")
    kap = (f"SELECT {k}, 'trait' AS level, trait, qwk FROM t_qwk UNION ALL "
           f"SELECT {k}, 'overall' AS level, '*' AS trait, qwk FROM p_qwk")
    return [*EV, *_qwk_ctes(keys + ["trait"], "t"), *_qwk_ctes(keys, "p"), ("radd", add), ("rkap", kap),
            ("rep", f"SELECT radd.*, rkap.qwk FROM radd LEFT JOIN rkap USING ({k}, level, trait)")]


@register("rubric_report", O.with_(*_rubric_sql_ctes(), select="SELECT * FROM rep"))
def rubric_report(spark, d):
    """Per-rubric and overall rows of accuracy, MAE, RMSE and QWK."""
    return M.rubric_report(_ev(spark, d), RUN + ["rater"])


@register("score_distribution", O.with_(*EV, (
        "c", f"SELECT {K_RUN_T}, yp AS pred, count(*) AS n FROM pe GROUP BY {K_RUN_T}, yp"),
        ("g", f"SELECT DISTINCT {K_RUN_T} FROM c"),
        ("b", f"SELECT {K_RUN_T}, CAST(unnest(range(0, 6)) AS INTEGER) AS pred FROM g"),
        select=(f"SELECT b.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n, CAST(coalesce(c.n, 0) AS DOUBLE) / "
                f"CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY {', '.join('b.' + x for x in RUN_T)}) AS DOUBLE) AS share "
                f"FROM b LEFT JOIN c USING ({K_RUN_T}, pred)")))
def score_distribution(spark, d):
    """Prediction distribution by score bucket 0..5."""
    return R.score_distribution(_preds(spark, d), RUN_T)


@register("high_error", O.with_(*P, (
        "er", f"SELECT split, variant, exp, trait, essay_id, pred01 - {_LABEL} AS err FROM predictions"),
        ("rk", "SELECT *, CAST(row_number() OVER (PARTITION BY split, variant, exp, trait ORDER BY abs(err) DESC, "
               "essay_id ASC) AS INTEGER) AS rank FROM er"),
        ("pv", f"SELECT split, variant, trait, essay_id, rank AS prev_rank, err AS prev_err FROM rk "
               f"WHERE exp = 0 AND rank <= {TOP_K}"),
        ("cu", f"SELECT split, variant, trait, essay_id, rank AS cur_rank, err AS cur_err FROM rk "
               f"WHERE exp = 1 AND rank <= {TOP_K}"),
        select="SELECT * FROM pv FULL OUTER JOIN cu USING (split, variant, trait, essay_id)"))
def high_error(spark, d):
    """Top-10 high-error essays of the previous (exp 0) and current (exp 1) run."""
    return R.high_error(_preds(spark, d), ["split", "variant", "trait"], "exp", 0, 1, TOP_K)


@register("regression_delta", O.with_(*_rubric_sql_ctes(), (
        "ml", "\nUNION ALL\n".join(f"SELECT split, variant, exp, rater, level, trait, '{m}' AS metric, "
                                   f"CAST({m} AS DOUBLE) AS value FROM rep" for m in ("accuracy", "qwk", "mae", "rmse"))),
        ("bs", "SELECT split, variant, rater, level, trait, metric, value AS baseline FROM ml WHERE exp = 0"),
        ("cd", "SELECT split, variant, rater, level, trait, metric, value AS candidate FROM ml WHERE exp = 1"),
        select=(f"SELECT *, candidate - baseline AS delta, "
                f"abs(candidate - baseline) > {DELTA_TOLERANCE} AS flagged "
                f"FROM bs FULL OUTER JOIN cd USING (split, variant, rater, level, trait, metric)")))
def regression_delta(spark, d):
    """Candidate (exp 1) minus baseline (exp 0) for every metric row."""
    keys = ["split", "variant", "rater", "level", "trait"]
    rep = M.rubric_report(_ev(spark, d), RUN + ["rater"])
    long = R.metrics_long(rep, keys + ["exp"])
    return R.regression_delta(long, keys, "exp", 0, 1, DELTA_TOLERANCE)


@register("variant_summary", O.with_(*EV, *_agreement_ctes(RUN_T + ["rater"], "a"), O.history_cte(), *STOP_SQL,
                                     *_batch_sql("predictions"), (
        "tm", f"SELECT split, variant, exp, rater, {SR('avg(accuracy)')} AS acc, "
              f"{SR('avg(qwk)')} AS qwk FROM a_agr GROUP BY split, variant, exp, rater"),
        ("wd", "SELECT split, variant, exp, max(CASE WHEN rater = 'r1' THEN acc END) AS r1_acc_mean, "
               "max(CASE WHEN rater = 'r1' THEN qwk END) AS r1_qwk_mean, max(CASE WHEN rater = 'r2' THEN acc END) "
               "AS r2_acc_mean, max(CASE WHEN rater = 'r2' THEN qwk END) AS r2_qwk_mean FROM tm GROUP BY split, variant, exp"),
        select=(f"SELECT wd.*, {SR('mb.loss')} AS test_loss, sb.best_val_loss FROM wd "
                "LEFT JOIN mb USING (split, variant, exp) "
                "LEFT JOIN (SELECT DISTINCT variant, exp, best_val_loss FROM stop) sb USING (variant, exp)")))
def variant_summary(spark, d):
    """Per split and run: mean accuracy / QWK per rater, loss and best val loss."""
    e = _essays(spark, d)
    preds = FX.predictions_from_scores(L.scores_long(e))
    ev = L.evaluation_rows(preds, RUN_T)
    loss = H.mse_batch_mean(preds, H.eval_batch_ids(e, EVAL_BATCH), RUN)
    stop = H.early_stopping(FX.history(spark, d), PATIENCE, ["run_id", "variant", "exp"])
    return _rounded(R.variant_summary(ev, loss, stop, RUN), "r1_acc_mean", "r1_qwk_mean", "r2_acc_mean", "r2_qwk_mean",
                    "test_loss")


FLAGSHIP = "agreement_by_trait"


# ================================================================== E1 / F1 / F2 (no SQL twin)

ENCODER_DIM = 256


@register("embed_sentences")
def embed_sentences(spark, d):
    """Built-in encoder (hashing TF-IDF, IDF fitted on train) on every sentence."""
    from kappaflow.plans.pipelines import sentence_vectors
    return sentence_vectors(_essays(spark, d), "none", ENCODER_DIM)


def _fit(spark, d):
    from kappaflow.plans.pipelines import sentence_vectors, train_and_predict
    from kappaflow.operators.scorer import ScorerConfig
    e = _essays(spark, d)
    return train_and_predict(e, lambda at: sentence_vectors(e, "none", ENCODER_DIM, as_vector=True, path=at), ScorerConfig(), "kobert", 0)


FIT_EPOCHS = 12


@register("fit_scorer", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', true, true)" for t in TRAITS)
          + ") t(trait, beats_mean, epoch_in_range)")
def fit_scorer(spark, d):
    """F1 by mini-batches on ratings that the texts decide: per trait whether
    the test loss lies below that of the training rows' mean label, and
    whether the best epoch is one that was run."""
    from kappaflow.operators.minibatch import MinibatchConfig
    from kappaflow.plans.pipelines import sentence_vectors, train_and_predict
    e = FX.text_rated(_essays(spark, d))
    vec = lambda at: sentence_vectors(e, "none", ENCODER_DIM, as_vector=True, path=at)
    cfg = MinibatchConfig(epochs=FIT_EPOCHS, batch_size=128, batches_per_pass=4, lr=0.03)
    scorer, hist, preds = train_and_predict(e, vec, cfg, "kobert", 0)
    in_range = 0 <= scorer.best_epoch < hist.count()
    truth = preds.withColumn("label", label01("r1", "r2"))
    mean = truth.where("split = 'train'").groupBy("trait").agg(F.avg("label").alias("m"))
    loss = (truth.where("split = 'test'").join(F.broadcast(mean), "trait").groupBy("trait")  # one row a trait
            .agg(F.avg((F.col("pred01") - F.col("label")) ** 2).alias("own"), F.avg((F.col("m") - F.col("label")) ** 2).alias("base")))
    return loss.select("trait", (F.col("own") < F.col("base")).alias("beats_mean"), F.lit(in_range).alias("epoch_in_range"))


@register("score_essays")
def score_essays(spark, d):
    """F2: 0..1 predictions of the fitted scorer for every essay and trait."""
    _, _, preds = _fit(spark, d)
    return preds.select("essay_id", "split", "variant", "exp", "trait", "pred01", "r1", "r2")
