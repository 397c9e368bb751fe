"""Sentence encoding (E1 - E3): one vector per sentence, in distributed batches.

Two paths:

* ``fit_hashing_encoder`` / ``encode_hashing`` - the built-in encoder, all
  Spark ML on the JVM: word split, feature hashing, IDF fitted on the
  training sentences, L2 normalisation.
* ``encode_with_model`` - a user-supplied model (e.g. a BERT exported to
  ONNX) through ``predict_batch_udf``: Arrow batches of ``batch_size``
  sentences reach the model as fixed-length token id / mask matrices, and
  the model returns one vector per sentence (``cls_vectors`` takes the
  first-token state of a ``(batch, tokens, hidden)`` output).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.functions.text import SPECIAL_IDS, hash_token_ids
from kappaflow.operators.text import tokenize
from kappaflow.schema import MAX_TOKENS_RAW, SENTENCE_BATCH

WORD_GAPS = r"[ \t\n\x0B\f\r]+"
KEYS = ("essay_id", "split", "pos")


def fit_hashing_encoder(train_rows: DataFrame, dim: int = 256, text_col: str = "sentence") -> PipelineModel:
    """Fit the built-in encoder; only IDF needs a pass (document frequency
    per hash bucket, a ``dim``-sized distributed aggregate)."""
    return Pipeline(stages=[*_hashing(dim, text_col), *_weighting()]).fit(train_rows.select(text_col))


def _hashing(dim: int, text_col: str) -> list:
    return [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=WORD_GAPS, gaps=True, toLowercase=True),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)]


def _weighting() -> list:
    return [IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)]


def encode_hashing(model: PipelineModel, rows: DataFrame, keys=KEYS, as_vector: bool = False) -> DataFrame:
    """E1 with the built-in encoder: (keys, embedding array<float>).

    ``as_vector`` keeps the (sparse) ML vector instead, for jobs that pool
    right away: no densify / convert round trip."""
    out = model.transform(rows.select(*keys, "sentence"))
    if as_vector:
        return out.select(*keys, F.col("_vec").alias("embedding"))
    return out.select(*keys, vector_to_array("_vec", "float32").alias("embedding"))


def encode_hashing_once(rows: DataFrame, path: str, train_split: str = "train", dim: int = 256, keys=KEYS) -> DataFrame:
    """``encode_hashing`` with ``as_vector`` by an encoder fitted on the rows of
    ``train_split``, cutting and hashing every text once: the sparse word counts
    are written to ``path``, which fit and weighting read; the caller drops it
    when the vectors are used."""
    hashed = PipelineModel(_hashing(dim, "sentence")).transform(rows.select(*keys, "sentence")).select(*keys, "_tf")
    hashed.write.parquet(path)
    hashed = rows.sparkSession.read.schema(hashed.schema).parquet(path)
    model = Pipeline(stages=_weighting()).fit(hashed.where(F.col("split") == train_split).select("_tf"))
    return model.transform(hashed).select(*keys, F.col("_vec").alias("embedding"))


def cls_vectors(hidden: np.ndarray) -> np.ndarray:
    """First-token (CLS) state of every sentence."""
    return hidden[:, 0, :]


def encode_with_model(rows: DataFrame, make_predict_fn, max_len: int = MAX_TOKENS_RAW,
                      batch_size: int = SENTENCE_BATCH, keys=KEYS, rebalance: bool = True,
                      tokenizer=hash_token_ids, special: tuple[int, int, int] = SPECIAL_IDS) -> DataFrame:
    """E1 + E2 with a supplied model.

    ``make_predict_fn()`` runs once per Python worker and returns
    ``predict(input_ids, attention_mask) -> (n, dim) float array``; ids come
    from ``tokenizer`` (see ``operators.text.tokenize``).  Sentences are dealt
    out by their key first (``rebalance``), so one very long essay does not
    leave its sentences in a single task."""
    if rebalance:
        rows = rows.repartition(*keys)
    toks = tokenize(rows, max_len, keys, tokenizer, special)
    enc = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[max_len], [max_len]])
    return toks.select(*keys, enc(F.col("input_ids"), F.col("attention_mask")).alias("embedding"))
