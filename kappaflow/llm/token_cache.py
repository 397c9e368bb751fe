"""Token counts through a digest cache.

A document's content digest is joined to a stored table of counts, kept per
tokenizer version; only contents that the table lacks are encoded, each
distinct content once, and their counts are appended to the table.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
each get a row; an empty table gives an empty result; other columns of the
input are ignored unless named in ``keep``; a null doc_id is kept as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm import bpe

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
EDGE_SPACE = " \t\n\r"
_MEMOS: dict[str, bpe.ChunkMemo] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        body = hashlib.sha256(f.read())
    body.update(f"tokenizers {tokenizers.__version__}; edge space trimmed".encode())
    return body.hexdigest()[:32]


def content_digest(text):
    """SHA-256 of the normalised content.  Normalising drops white space at
    both ends, which this operator's tokenizers do not count."""
    return F.unhex(F.sha2(normalised(text), 256))


def normalised(text):
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(EDGE_SPACE))


def count_texts(texts: Sequence[str], memo: bpe.ChunkMemo) -> list[int]:
    """Tokens of each text for a tokenizer whose pieces never span a space or
    a line end."""
    out: list[int] = []
    for part in bpe.sub_batches(texts):
        words = [t.replace("\n", " ").split(" ") for t in part]
        known = memo.values(set().union(*words)).__getitem__
        out.extend(sum(map(known, w)) for w in words)
    return out


def _memo(path: str) -> bpe.ChunkMemo:
    if path not in _MEMOS:
        tok = bpe.load(path)
        _MEMOS[path] = bpe.ChunkMemo(
            lambda chunks: [len(e) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)])
    return _MEMOS[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for b in batches:
            n = count_texts(b.column(1).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(n, pa.int64())],
                                             names=["digest", "n_tokens"])
    return run


def read_cache(docs: DataFrame, store: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest."""
    spark = docs.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(store)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return (spark.read.schema(CACHE_SCHEMA).parquet(store)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_dir: str, text: str = "text") -> str:
    """Append the counts of all contents in ``docs`` that the cache lacks;
    returns the folder of this tokenizer version.

    The partial half of ``dropDuplicates`` drops copies before the shuffle, so
    a content that fills a third of the table costs one row per task."""
    store = f"{cache_dir.rstrip('/')}/version={tokenizer_version(tokenizer_path)}"
    wanted = (docs.select(content_digest(F.col(text)).alias("digest"), normalised(F.col(text)).alias("text"))
              .dropDuplicates(["digest"]))
    missing = wanted.join(read_cache(docs, store).select("digest"), "digest", "left_anti")
    missing.select("digest", "text").mapInArrow(_encoder(tokenizer_path), CACHE_SCHEMA) \
        .write.mode("append").parquet(store)
    return store


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str, text: str = "text",
                 keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_bytes (UTF-8) and n_tokens of every row.

    Two reads of the input: one to fill the cache, one that carries only
    digests to the join with it."""
    store = fill_cache(docs, tokenizer_path, cache_dir, text)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                       F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"),
                       content_digest(F.col(text)).alias("digest"))
    return (rows.join(read_cache(docs, store), "digest", "left")
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens"))
