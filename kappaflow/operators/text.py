"""Sentence, token and prompt-filter operators over the essay table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaflow.functions import text as T
from kappaflow.operators.ordering import row_index
from kappaflow.schema import MAX_SENTENCES, PROMPT_COL, TEXT_COL, VARIANTS, q


def sentences(essays: DataFrame, mode: str = "none", keys=("essay_id", "split"),
              max_sentences: int | None = None) -> DataFrame:
    """One row per essay with its ordered sentence array.

    ``mode``: none | labeled (``<prompt>###s``) | fine_tune (``<prompt>#s``) |
    prompt_first (extra first sentence ``prompt:<prompt>``).
    ``max_sentences`` keeps the first n sentences of every essay (default:
    all).  An essay without text has a NULL array."""
    raw = T.split_sentences(F.col(q(TEXT_COL)))
    s = essays.select(*keys, T.attach_prompt(raw, F.col(q(PROMPT_COL)), mode).alias("sentences"))
    return s if max_sentences is None else s.withColumn("sentences", T.cap_sentences("sentences", max_sentences))


def sentence_rows(sents: DataFrame, keys=("essay_id", "split")) -> DataFrame:
    """One row per sentence with its 0-based position (order kept)."""
    return sents.select(*keys, F.posexplode("sentences").alias("pos", "sentence"))


def sentence_counts(sents: DataFrame, keys=("essay_id", "split")) -> DataFrame:
    """Sentences per essay."""
    return sents.select(*keys, F.size("sentences").alias("n_sentences"))


def tokenize(rows: DataFrame, max_len: int, keys=("essay_id", "split", "pos"),
             tokenizer=T.hash_token_ids, special: tuple[int, int, int] = T.SPECIAL_IDS) -> DataFrame:
    """D8 + D9: fixed-length token ids and attention mask per sentence.

    ``tokenizer`` maps the sentence column to an ``array<int>`` column of ids
    without special tokens: an expression, or ``functions.text.model_tokenizer``
    around a tokenizer library; ``special`` are its pad, CLS and SEP ids."""
    pad, cls, sep = special
    t = rows.select(*keys, tokenizer(F.col("sentence")).alias("_ids"))
    return t.select(*keys, T.pad_token_ids(F.col("_ids"), max_len, pad, cls, sep).alias("input_ids"),
                    T.attention_mask(F.col("_ids"), max_len).alias("attention_mask"))


def first_prompt(essays: DataFrame, n_rows: int = 1, split: str = "train") -> DataFrame:
    """Prompts of the first ``n_rows`` essays (lowest essay_id) of a split.

    ``n_rows`` counts rows, not distinct prompts, like the original list
    slice.  ``orderBy().limit()`` plans as a distributed top-k
    (TakeOrderedAndProject): each task keeps n rows, the driver merges."""
    first = (essays.where(F.col("split") == split)
             .select("essay_id", F.col(q(PROMPT_COL)).alias("prompt"))
             .orderBy("essay_id").limit(n_rows))
    return first.select("prompt").distinct()


def filter_by_prompts(essays: DataFrame, prompts: DataFrame) -> DataFrame:
    """Keep essays whose prompt is in ``prompts`` (at most n rows, so
    broadcast is safe).  Apply before any encoder: a semi join is not pushed
    below a Python UDF by the optimizer."""
    p = prompts.select(F.col("prompt").alias("_p"))
    return essays.join(F.broadcast(p), F.col(q(PROMPT_COL)) == F.col("_p"), "left_semi")


def renumber(df: DataFrame, by=("split",), order=("essay_id",), out: str = "row") -> DataFrame:
    """Dense 0-based row numbers per split after a filter (distributed)."""
    return row_index(df, list(order), list(by), out)


def variant_fanout(essays: DataFrame, variants=VARIANTS, keys=("essay_id", "split"),
                   with_prompt_mode: str = "labeled") -> DataFrame:
    """One row per (essay, variant); prompt-labeled variants prefix every
    sentence.  The variant list is a fixed literal array, so this is an
    ``explode`` (a generator), not a join."""
    fan = F.explode(F.array(*[F.struct(F.lit(tag).alias("variant"), F.lit(wp).alias("with_prompt"))
                              for tag, wp in variants])).alias("v")
    raw = T.split_sentences(F.col(q(TEXT_COL)))
    e = essays.select(*keys, F.col(q(PROMPT_COL)).alias("prompt"), raw.alias("_s"), fan)
    sents = F.when(F.col("v.with_prompt"), T.attach_prompt(F.col("_s"), F.col("prompt"), with_prompt_mode)) \
             .otherwise(F.col("_s"))
    return e.select(*keys, F.col("v.variant").alias("variant"), F.col("v.with_prompt").alias("with_prompt"),
                    sents.alias("sentences"))


__all__ = ["sentences", "sentence_rows", "sentence_counts", "tokenize", "first_prompt",
           "filter_by_prompts", "renumber", "variant_fanout", "MAX_SENTENCES"]
