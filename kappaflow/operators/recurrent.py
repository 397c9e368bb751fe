"""Sequence models over chunked essays (F2 / E8 with a supplied model).

An essay's vectors come as rows of at most a chunk of positions
(``sequence.chunked_sequences``).  A layer reads an essay's chunks in order
and carries the recurrent state from one to the next, so an essay of any
length never is one row: a task holds one chunk and one state.  Layers of both
directions stack (``bidirectional``), and ``final_states`` gives the vector that
a scorer reads.

A cell is any object with ``start() -> state`` and
``run(state, x) -> (outputs, state)`` for the vectors ``x`` (n, dim) of one
chunk, outputs (n, width); ``make_cell()`` builds it once in each task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.session import drop_path, shared_dir

KEYS = ("essay_id", "split")


class GRUCell:
    """One direction of a gated recurrent layer with trained weights: ``w_ih``
    (3 * width, dim), ``w_hh`` (3 * width, width) and their biases, rows in the
    order reset, update, new."""

    def __init__(self, w_ih, w_hh, b_ih, b_hh):
        self.w_ih, self.w_hh, self.b_ih, self.b_hh = (np.asarray(x, dtype=np.float64) for x in (w_ih, w_hh, b_ih, b_hh))
        self.width = self.w_hh.shape[1]

    def start(self) -> np.ndarray:
        return np.zeros(self.width)

    def run(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.width
        given = x @ self.w_ih.T + self.b_ih
        out = np.empty((len(x), w))
        for k, g in enumerate(given):
            s = self.w_hh @ h + self.b_hh
            reset, update = 1 / (1 + np.exp(-(g[:2 * w] + s[:2 * w]))).reshape(2, w)
            new = np.tanh(g[2 * w:] + reset * s[2 * w:])
            h = (1 - update) * new + update * h
            out[k] = h
        return out, h


class DecayCell:
    """h = rate * h + (1 - rate) * x: a running mean that forgets."""

    def __init__(self, dim: int, rate: float = 0.5):
        self.dim, self.rate = dim, rate

    def start(self) -> np.ndarray:
        return np.zeros(self.dim)

    def run(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(x.shape)
        for k, v in enumerate(x):
            h = self.rate * h + (1 - self.rate) * v
            out[k] = h
        return out, h


def _layer(make_cell: Callable, n_keys: int, reverse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now, state = make_cell(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(k).to_pylist() for k in range(n_keys))))
            rows = b.column("vectors")
            at = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            flat = rows.flatten()
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
            outs = []
            for key, lo, hi in zip(keys, at[:-1], at[1:]):
                if key != now:
                    now, state = key, cell.start()
                part = x[lo:hi]
                out, state = cell.run(state, part[::-1] if reverse else part)
                outs.append(out[::-1] if reverse else out)
            out = np.concatenate(outs)
            width = out.shape[1]
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            vectors = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], names=b.schema.names)
    return run


def layer(chunks: DataFrame, make_cell: Callable, reverse: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """The cell's output at every position, in chunks as they came; with
    ``reverse`` essays are read from their end."""
    keys = list(keys)
    rows = chunks.select(*keys, "chunk", "n", "vectors")
    order = F.col("chunk").desc() if reverse else F.col("chunk").asc()
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("vectors", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return (rows.repartition(*keys).sortWithinPartitions(*keys, order)
            .mapInArrow(_layer(make_cell, len(keys), reverse), schema))


def bidirectional(chunks: DataFrame, layers: Sequence[tuple[Callable, Callable]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Stacked layers of two directions: each position's outputs forward and
    backward, side by side, feed the next layer.  A finished layer is written
    to shared storage, so the next one reads it twice without running it
    again; the one before goes then."""
    keys, spark = list(keys), chunks.sparkSession
    root = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    for k, (forward, backward) in enumerate(layers):
        both = layer(chunks, forward, keys=keys).join(
            layer(chunks, backward, True, keys).select(*keys, "chunk", F.col("vectors").alias("_b")), [*keys, "chunk"])
        both = both.withColumn("vectors", F.zip_with("vectors", "_b", lambda x, y: F.concat(x, y))).drop("_b")
        both.write.parquet(f"{root}/{k}")
        if k:
            drop_path(spark, f"{root}/{k - 1}")
        chunks = spark.read.schema(both.schema).parquet(f"{root}/{k}")
    return chunks


def final_states(chunks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per essay: seq_len and the output at its true last position, as the
    ``features`` vector of a scorer (a batch's padding never matters)."""
    last = chunks.groupBy(*keys).agg(F.sum("n").alias("seq_len"), F.max_by(F.element_at("vectors", -1), "chunk").alias("v"))
    return last.select(*keys, "seq_len", array_to_vector("v").alias("features"))
