"""Column expressions for sentences and tokens (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Iterator

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kappaflow.schema import FINE_TUNE_SEP, LABEL_SEP, PROMPT_FIRST_PREFIX, SENTENCE_SEP

# Prompt attachment modes: how the prompt joins the sentences of an essay.
PROMPT_MODES = {
    "none": None,
    "labeled": LABEL_SEP,        # every sentence becomes "<prompt>###<sentence>"
    "fine_tune": FINE_TUNE_SEP,  # every sentence becomes "<prompt>#<sentence>"
    "prompt_first": None,        # one extra first sentence "prompt:<prompt>"
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_sentences(text, sep: str = SENTENCE_SEP) -> Column:
    """Split on a literal separator keeping every piece: a trailing separator
    gives a trailing empty sentence, '' gives [''] and NULL stays NULL."""
    pattern = r"\Q" + sep + r"\E" if r"\E" not in sep else re.escape(sep)
    return F.split(_col(text), pattern, -1)


def prefix_sentences(sentences, prompt, sep: str = LABEL_SEP) -> Column:
    """Prefix every sentence with ``<prompt><sep>``."""
    p = _col(prompt)
    return F.transform(_col(sentences), lambda s: F.concat(p, F.lit(sep), s))


def prompt_first(sentences, prompt, prefix: str = PROMPT_FIRST_PREFIX) -> Column:
    """Put ``prompt:<prompt>`` in front as an extra first sentence."""
    return F.concat(F.array(F.concat(F.lit(prefix), _col(prompt))), _col(sentences))


def attach_prompt(sentences, prompt, mode: str) -> Column:
    if mode not in PROMPT_MODES:
        raise ValueError(f"unknown prompt mode {mode!r}; one of {sorted(PROMPT_MODES)}")
    if mode == "none":
        return _col(sentences)
    if mode == "prompt_first":
        return prompt_first(sentences, prompt)
    return prefix_sentences(sentences, prompt, PROMPT_MODES[mode])


def cap_sentences(sentences, max_sentences: int) -> Column:
    """Keep the first ``max_sentences`` sentences."""
    return F.slice(_col(sentences), 1, max_sentences)


def words(sentence) -> Column:
    """Whitespace word split without empty pieces."""
    return F.filter(F.split(_col(sentence), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != F.lit(""))


def hash_token_ids(sentence, vocab_size: int = 8000, first_id: int = 5) -> Column:
    """Word-level hashing tokenizer: id = first_id + (md5 bucket of the word).

    md5 is used (not xxhash64) so the ids are reproducible in any SQL engine;
    a real word-piece tokenizer plugs in through ``model_tokenizer``.
    """
    return F.transform(
        words(sentence),
        lambda w: (F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"), F.lit(vocab_size))
                   + F.lit(first_id)).cast("int"))


SPECIAL_IDS = (1, 2, 3)  # pad, CLS, SEP of the built-in ids


def model_tokenizer(make_encode):
    """A tokenizer for ``operators.text.tokenize`` from a library.

    ``make_encode()`` runs once per Python worker and returns
    ``encode(list[str]) -> list[list[int]]``; sentences come in Arrow batches,
    a NULL sentence as an empty one."""
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encode()
        for s in batches:
            yield pd.Series(encode(s.fillna("").tolist()), dtype=object)
    # types are named here: the module's annotations are strings
    ids.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(ids, "array<int>")


def pad_token_ids(ids, max_len: int, pad_id: int = 1, cls_id: int = 2, sep_id: int = 3) -> Column:
    """``[CLS] ids [SEP]`` truncated to ``max_len`` (special tokens included)
    and right-padded with ``pad_id`` to exactly ``max_len``."""
    body = F.slice(_col(ids), 1, max_len - 2)
    framed = F.concat(F.array(F.lit(cls_id)), body, F.array(F.lit(sep_id)))
    return F.concat(framed, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(max_len) - F.size(framed))))


def attention_mask(ids, max_len: int) -> Column:
    """1 for the real (framed) tokens, 0 for padding, length ``max_len``."""
    n = F.least(F.size(_col(ids)) + 2, F.lit(max_len))
    return F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: F.when(i <= n, 1).otherwise(0))
