"""DuckDB SQL twins of the fixture views and operators.

Each registered query gets one self-contained SQL text over the raw tables
(``documents``, ``embeddings`` ...), built from the CTEs below, so the driver
can run it next to the Spark plan and compare results.
"""

from __future__ import annotations

from kappaflow.schema import SENTENCE_SEP, TRAITS
from kappaflow.sources.fixtures import (BATCHES_PER_EPOCH, DEFECT_EVERY, EPOCHS_PER_RUN, FIXTURE_EXPS, FIXTURE_VARIANTS,
                                         LONG_SENTENCES, LOST_EVERY, STRAY_POS)

RUN_KEYS = ["split", "variant", "exp"]
TRAIT_KEYS = RUN_KEYS + ["trait"]


def qi(name: str) -> str:
    return f'"{name}"'


def with_(*ctes: tuple[str, str], select: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{select}"


# --------------------------------------------------------------------------- fixtures

def essays_cte() -> tuple[str, str]:
    h = "(doc_id * 7 + n_chars)"
    cols = []
    for k, t in enumerate(TRAITS):
        a = f"(({h} + {k}) % 6)"
        b = f"least(5, greatest(0, {a} + ((doc_id * 3 + {k} + {h}) % 3) - 1))"
        if k == 0:
            a = f"(CASE WHEN {a} = 1 THEN 0 ELSE {a} END)"
            b = f"(CASE WHEN {b} = 1 THEN 0 ELSE {b} END)"
        cols.append(f"CAST({a} AS INTEGER) AS {qi('rater1@' + t)}")
        cols.append(f"CAST({b} AS INTEGER) AS {qi('rater2@' + t)}")
    sql = f"""SELECT doc_id AS essay_id,
  CASE WHEN (doc_id // 20) % 10 < 8 THEN 'train' WHEN (doc_id // 20) % 10 = 8 THEN 'valid' ELSE 'test' END AS split,
  lang || '/' || source AS "question@prompt",
  replace(text, chr(10), '{SENTENCE_SEP}') AS "answer@text",
  {", ".join(cols)}
FROM documents"""
    return "essays", sql


def scores_cte() -> tuple[str, str]:
    parts = [f"SELECT essay_id, split, '{t}' AS trait, CAST({k} AS INTEGER) AS k, "
             f"{qi('rater1@' + t)} AS r1, {qi('rater2@' + t)} AS r2 FROM essays"
             for k, t in enumerate(TRAITS)]
    return "scores", "\nUNION ALL\n".join(parts)


def predictions_cte() -> tuple[str, str]:
    fan = ", ".join(f"({v}, '{name}', {e})" for v, name in enumerate(FIXTURE_VARIANTS) for e in FIXTURE_EXPS)
    sql = f"""SELECT essay_id, split, variant, CAST(exp AS INTEGER) AS exp, trait, k, r1, r2,
  CAST(CASE WHEN k = 0 AND n20 BETWEEN 3 AND 5 THEN 2 ELSE n20 END AS DOUBLE) / CAST(20 AS DOUBLE) AS pred01
FROM (SELECT s.*, f.variant, f.exp,
        least(20, greatest(0, (s.r1 + s.r2) * 2 + (s.essay_id * 13 + s.k * 5 + f.v * 3 + f.exp * 2) % 7 - 3)) AS n20
      FROM scores s CROSS JOIN (VALUES {fan}) f(v, variant, exp)) z"""
    return "predictions", sql


def ev_ctes(keys=TRAIT_KEYS) -> list[tuple[str, str]]:
    k = ", ".join(keys)
    pe = ("pe", "SELECT *, CAST(least(5, greatest(0, round_even(pred01 * CAST(5 AS DOUBLE), 0))) AS INTEGER) AS yp "
                "FROM predictions")
    ev = ("ev", f"SELECT {k}, essay_id, yp, 'r1' AS rater, r1 AS yt FROM pe\nUNION ALL\n"
                f"SELECT {k}, essay_id, yp, 'r2' AS rater, r2 AS yt FROM pe")
    return [pe, ev]


def prediction_ctes() -> list[tuple[str, str]]:
    return [essays_cte(), scores_cte(), predictions_cte()]


def history_cte() -> tuple[str, str]:
    sql = f"""SELECT doc_id // {EPOCHS_PER_RUN} AS run_id,
  CASE WHEN (doc_id // {EPOCHS_PER_RUN}) % 2 = 0 THEN '{FIXTURE_VARIANTS[0]}' ELSE '{FIXTURE_VARIANTS[1]}' END AS variant,
  CAST((doc_id // {EPOCHS_PER_RUN}) // 2 AS INTEGER) AS exp,
  doc_id % {EPOCHS_PER_RUN} AS epoch,
  CAST(1 AS DOUBLE) / CAST(doc_id % {EPOCHS_PER_RUN} + 3 AS DOUBLE) AS train_loss,
  CAST(1 AS DOUBLE) / CAST(doc_id % {EPOCHS_PER_RUN} + 2 AS DOUBLE)
    + CAST((doc_id * 37 + n_chars) % 11 AS DOUBLE) / CAST(100 AS DOUBLE) AS val_loss
FROM documents"""
    return "history", sql


def spoiled_cte() -> tuple[str, str]:
    run = lambda v, e: f"(essay_id % 50 = 7 AND variant = '{FIXTURE_VARIANTS[v]}' AND exp = {e})"
    return "spoiled", (
        f"SELECT essay_id, split, variant, exp, trait, CASE WHEN {run(0, 0)} THEN NULL ELSE r1 END AS r1, r2, "
        f"CASE WHEN {run(0, 1)} THEN CAST(5e7 AS DOUBLE) WHEN {run(1, 0)} THEN CAST('inf' AS DOUBLE) "
        f"WHEN {run(1, 1)} THEN CAST('nan' AS DOUBLE) ELSE pred01 END AS pred01 FROM predictions")


def batch_losses_cte() -> tuple[str, str]:
    e, b = f"(doc_id // {BATCHES_PER_EPOCH})", f"(doc_id % {BATCHES_PER_EPOCH})"
    sql = f"""SELECT run_id, epoch, batch, loss * (run_id + 1) AS loss FROM (
  SELECT CAST(unnest([0, 1]) AS BIGINT) AS run_id, {e} AS epoch, {b} AS batch,
    CASE WHEN {b} = 37 AND {e} % 5 = 1 THEN NULL WHEN {b} = 37 AND {e} % 5 = 2 THEN CAST(5e7 AS DOUBLE)
      WHEN {b} = 37 AND {e} % 5 = 3 THEN CAST('inf' AS DOUBLE) WHEN {b} = 37 AND {e} % 5 = 4 THEN CAST('nan' AS DOUBLE)
      ELSE CAST(n_chars % 97 AS DOUBLE) / CAST(100 AS DOUBLE) END AS loss
  FROM documents) u"""
    return "batch_losses", sql


def sentences_ctes() -> list[tuple[str, str]]:
    return [essays_cte(),
            ("sent", f"SELECT essay_id, split, \"question@prompt\" AS prompt, "
                     f"string_split(\"answer@text\", '{SENTENCE_SEP}') AS sentences FROM essays"),
            ("srows", "SELECT essay_id, split, CAST(p - 1 AS INTEGER) AS pos, sentences[p] AS sentence "
                      "FROM (SELECT *, unnest(range(1, len(sentences) + 1)) AS p FROM sent) x")]


def defective_cte() -> tuple[str, str]:
    k = f"(essay_id % {DEFECT_EVERY})"
    r1, r2 = qi("rater1@" + TRAITS[0]), qi("rater2@" + TRAITS[1])
    return "defective", (f"SELECT * REPLACE (CASE WHEN {k} <> 7 THEN {r1} END AS {r1}, CASE WHEN {k} = 8 THEN 9 ELSE {r2} END AS {r2}, "
                         f"CASE WHEN {k} <> 9 THEN \"question@prompt\" END AS \"question@prompt\", "
                         f"CASE WHEN {k} <> 10 THEN \"answer@text\" END AS \"answer@text\") FROM essays")


def misaligned_cte() -> tuple[str, str]:
    return "mis", (f"SELECT essay_id, split, CASE WHEN (essay_id * 7 + pos) % {LOST_EVERY} = 0 THEN pos + {STRAY_POS} ELSE pos END AS pos FROM sv")


def long_essay_cte() -> tuple[str, str]:
    return "with_long", (f"SELECT essay_id, split, sentences FROM sent UNION ALL SELECT CAST(-1 AS BIGINT), 'train', "
                         f"list_transform(range(1, {LONG_SENTENCES + 1}), lambda i: 'sentence ' || i)")


def sentence_vector_ctes() -> list[tuple[str, str]]:
    return sentences_ctes() + [
        ("ne", "SELECT count(*) AS n FROM embeddings"),
        ("sv", "SELECT s.essay_id, s.split, s.pos, e.embedding FROM srows s CROSS JOIN ne "
               "JOIN embeddings e ON e.vec_id = (s.essay_id * 7 + s.pos) % ne.n")]


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def hash_ids_sql(col: str, vocab: int = 8000, first_id: int = 5) -> str:
    return (f"list_transform({words_sql(col)}, lambda w: CAST((('0x' || substr(md5(w), 1, 7))::BIGINT % {vocab}) "
            f"+ {first_id} AS INTEGER))")
