"""Quality selection by importance resampling over hashed n-grams.

Two generative bag-of-n-grams models over ``BUCKETS`` hashed features are
counted: the raw model over all documents where they are read, the target model
over all labelled good ones, found by a semi-join on their ids (one plan at
every size; Spark's runtime filter keeps other texts out of its shuffle).  A
document's importance weight
is the ratio of its probabilities under the two, log w = sum over its n-grams
of log target - log raw.  Sampling documents without replacement in proportion
to w is a Gumbel top-k: the k largest log w + Gumbel noise.  By default k is
the number of documents with log w >= ``LEAST_LOG_WEIGHT``: those that the raw
model explains no more than exp(10) times better than the target model.  A
short good text has a weight near 0; junk lies far below, out of the noise's
reach.

Features: word unigrams and bigrams (words and runs of symbols, lower-cased)
and bigrams of word shapes (case, digits, symbols, equal to the word before).

The noise is a hash of doc_id, text and seed, so a rerun draws the same sample.
The k-th largest key is found by counting keys in ever smaller ranges, never
by sorting or collecting documents.

Defined results: null and empty texts have no n-grams, weight 0 and take part;
repeated rows have equal keys, and if the k-th key is tied all rows that have
it are kept; without labelled good documents the target equals the raw model
and every weight is 0; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaflow.llm import bpe
from kappaflow.llm.common import Scratch, forgetting, runtime_filters

BUCKETS = 1 << 14
SMOOTHING = 1.0
SEED = 11
LEAST_LOG_WEIGHT = -10.0
MEMO_CHUNKS = 100_000
BATCH_DOCS = 1_000
BATCH_CHARS = 500_000
MARKS = 1 << 24  # bits (2 MB) that tell rows that may be dropped from all others
_PART = re.compile(r"\w+|[^\w\s]+")
_SHAPE_BITS = 3
_MEMO: list[bpe.ChunkMemo] = []


def _shape(part: str) -> int:
    """0 lower case or other letters, 1 capitalised, 2 upper case, 3 has a
    digit, 4 one symbol, 5 several symbols."""
    if not (part[0].isalnum() or part[0] == "_"):
        return 4 if len(part) == 1 else 5
    if any(c.isdigit() for c in part):
        return 3
    if len(part) > 1 and part.isupper():
        return 2
    return 1 if part[0].isupper() else 0


def _parts(chunk: str) -> bytes:
    """Packed (hash << 3 | shape) of the parts of a chunk without white space."""
    out = [(xxhash.xxh3_64_intdigest(p.lower()) << _SHAPE_BITS | _shape(p)) & 0xFFFFFFFFFFFFFFFF
           for p in _PART.findall(chunk)]
    return struct.pack(f"<{len(out)}Q", *out)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature bucket, text number) of every n-gram of the texts."""
    if not _MEMO:
        _MEMO.append(bpe.ChunkMemo(lambda chunks: [_parts(c) for c in chunks], MEMO_CHUNKS))
    words = [t.split() for t in texts]
    known = _MEMO[0].values(set().union(*words)).__getitem__
    raw = [b"".join(map(known, w)) for w in words]
    x = np.frombuffer(b"".join(raw), dtype="<u8")
    doc = np.repeat(np.arange(len(texts)), [len(r) // 8 for r in raw])
    shape = (x & np.uint64(7)).astype(np.int64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    word = (x >> np.uint64(_SHAPE_BITS)) * mul
    one = (word >> np.uint64(50)).astype(np.int64)  # 14 bits
    same_doc = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, dtype=bool)
    two = (((word[:-1] ^ (word[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[1:]) * mul >> np.uint64(50)).astype(np.int64)
    again = (word[1:] == word[:-1]).astype(np.int64)
    shapes = BUCKETS + (shape[:-1] * 8 + shape[1:]) * 2 + again
    return (np.concatenate([one, two[same_doc], shapes[same_doc]]),
            np.concatenate([doc, doc[1:][same_doc], doc[1:][same_doc]]))


FEATURES = BUCKETS + 128


def _forget() -> None:
    _MEMO.clear()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``BATCH_DOCS`` rows, so that few texts are Python strings
    at a time."""
    return (b.slice(i, BATCH_DOCS) for b in batches for i in range(0, b.num_rows, BATCH_DOCS))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of the texts of a task."""
    total = np.zeros(FEATURES, dtype=np.int64)
    for b in _small(batches):
        for part in bpe.sub_batches([t or "" for t in b.column(0).to_pylist()], BATCH_CHARS):
            total += np.bincount(_features(part)[0], minlength=FEATURES)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["feature", "n"])


def _counts(texts: DataFrame) -> np.ndarray:
    """Counts of all features, summed on Spark."""
    out = np.zeros(FEATURES)
    per_task = texts.select("text").mapInArrow(forgetting(_counter, _forget), "feature bigint, n bigint")
    for r in per_task.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


def fit(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log target - log raw probability of every feature; ``good`` holds the
    doc_ids of good documents, all of which the target model counts.  The raw
    model reads all documents; ``FEATURES`` counts of each reach the driver."""
    ids = good.select("doc_id").dropna()
    with runtime_filters(docs.sparkSession, many=True):
        target = _counts(docs.join(ids, "doc_id", "left_semi"))
    if not target.any():
        return np.zeros(FEATURES)
    n = np.array([_counts(docs), target])
    out = np.empty((2, FEATURES))
    for kind in (slice(0, BUCKETS), slice(BUCKETS, FEATURES)):
        m = n[:, kind] + SMOOTHING
        out[:, kind] = np.log(m / m.sum(axis=1, keepdims=True))
    return out[1] - out[0]


def _scorer(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            weights, noise = [], []
            ids = b.column(0).to_pylist()
            for part in bpe.sub_batches(texts, BATCH_CHARS):
                f, d = _features(part)
                weights.append(np.bincount(d, weights=ratio[f], minlength=len(part)))
            for i, t in zip(ids, texts):
                u = (xxhash.xxh3_64_intdigest(f"{i}\0{t}".encode("utf-8", "surrogatepass"), seed=SEED) + 0.5) / 2.0**64
                noise.append(-np.log(-np.log(min(max(u, 1e-18), 1 - 1e-16))))
            w = np.concatenate(weights) if weights else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(w), pa.array(w + np.array(noise))],
                                             names=["doc_id", "tk", "log_weight", "gumbel_key"])
    return run


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, tk, log_weight, gumbel_key) of every row; tk hashes the text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"))
    return rows.mapInArrow(forgetting(_scorer(ratio), _forget), "doc_id bigint, tk bigint, log_weight double, gumbel_key double")


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest of a column of finite doubles, exactly: the range
    that holds it is cut into 65,536 cells and counted until it is one value."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    while True:
        if lo == hi:
            return lo
        step = (hi - lo) / 65536
        cell = F.least(F.floor((F.col(column) - lo) / step), F.lit(65535)).cast("int")
        inside = keys.filter(F.col(column).between(lo, hi))
        found = sorted(((r["c"], r["n"], r["a"], r["b"]) for r in inside.groupBy(cell.alias("c")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()), reverse=True)
        for _, n, a, b in found:
            if k <= n:
                lo, hi = a, b
                break
            k -= n


def resample(docs: DataFrame, good: DataFrame, k: int | None = None) -> DataFrame:
    """Every row of ``docs`` as doc_id, tk, log_weight, gumbel_key and kept."""
    scratch = Scratch(docs.sparkSession, "importance")
    scored = scratch.write(weights(docs, fit(docs, good)), "weights")
    if k is None:
        k = scored.filter(F.col("log_weight") >= LEAST_LOG_WEIGHT).count()
    n = scored.count()
    if k >= n:
        return scored.withColumn("kept", F.lit(True))
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_largest(scored, "gumbel_key", k)))


def _marks(cells: DataFrame) -> DataFrame:
    """The distinct numbers ``cell`` (from 0 to ``MARKS``) as bitmaps of 32,768
    bits: (block, bits), at most ``MARKS`` / 8 bytes, however many there are."""
    return cells.groupBy(F.expr("cell div 32768").alias("block")).agg(
        F.bitmap_construct_agg(F.expr("cell % 32768")).alias("bits"))


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (with ``cell``) and whether their cell is marked."""
    at = rows.join(F.broadcast(marks), F.expr("cell div 32768") == F.col("block"), "left")  # bounded by MARKS
    byte = "cast(conv(hex(substring(bits, cast(cell % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return at.select(*rows.columns, F.expr(f"bits is not null and getbit({byte}, cast(cell % 8 as int)) = 1").alias("marked"))


def keep_good(docs: DataFrame, good: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs``.  Rows equal in doc_id and text share their
    key, so those of the written drop list go.  Only rows that share a mark with
    one of the list are joined with it; the texts of the others do not move."""
    drop = resample(docs, good, k).filter("not kept").select(F.col("doc_id").alias("drop_id"), F.col("tk").alias("drop_tk")).distinct()
    drop = Scratch(docs.sparkSession, "importance-drop").write(drop, "drop")

    def cell(doc_id: str, tk: str) -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id), F.col(tk)), F.lit(MARKS)).alias("cell")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).select(
        "d", F.col("d.doc_id").cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))).alias("tk"))
    rows = _marked(rows.select("*", cell("id", "tk")), _marks(drop.select(cell("drop_id", "drop_tk"))))
    # the key needs the mark, or the planner would join all rows with the list first
    found = rows.filter("marked").withColumn("tk", F.when(F.col("marked"), F.col("tk"))).join(
        drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("tk") == F.col("drop_tk")), "left_anti")
    return rows.filter("not marked").unionByName(found).select(*[F.col(f"d.`{c}`") for c in docs.columns])
