"""Trait scorer.

One sigmoid output per trait over a pooled essay vector, trained on the MSE
of the 0..1 labels with Adam, one full-data gradient step per epoch, early
stopping on validation loss (patience, strict improvement) and the best
epoch's weights kept - the shape of the original training loop, with the
sequence model replaced by pooling (E8).

Each epoch is one Spark job: tasks compute gradient / loss sums of their rows
with numpy on Arrow batches and emit one vector per task; ``Summarizer.sum``
adds those vectors with map-side partial aggregation.  Only the model
(traits x (dim + 1) numbers) and per-epoch scalars reach the driver.  Training
rows hold their numbers as bytes (``packed_rows``), which epochs read as
matrices without making an object per row.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.functions.scores import label01
from kappaflow.session import drop_path, shared_dir
from kappaflow.schema import BASE_SEED, N_EPOCHS, PATIENCE, TRAITS, q, rater_col


@dataclass
class ScorerConfig:
    lr: float = 0.05
    epochs: int = N_EPOCHS
    patience: int = PATIENCE
    seed: int = BASE_SEED
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    init_scale: float = 0.01
    train_split: str = "train"
    valid_split: str = "valid"
    traits: list = field(default_factory=lambda: list(TRAITS))


@dataclass
class TraitScorer:
    traits: list
    weights: np.ndarray   # (traits, dim)
    bias: np.ndarray      # (traits,)
    best_epoch: int = -1
    best_val_loss: float = float("nan")

    def transform(self, frame: DataFrame, keys=("essay_id", "split"), features_col: str = "features") -> DataFrame:
        """long predictions (keys, trait, pred01) for every row of ``frame``."""
        W, b = self.weights, self.bias
        keys = list(keys)
        x = frame.select(*keys, vector_to_array(features_col).alias("_x"))
        schema = T.StructType([f for k in keys for f in x.schema.fields if f.name == k]
                              + [T.StructField("_p", T.ArrayType(T.DoubleType()), False)])

        def score(batches):
            for rows in batches:
                if rows.num_rows:
                    P = 1.0 / (1.0 + np.exp(-(_list_matrix(rows.column(len(keys)), W.shape[1]) @ W.T + b)))
                    ends = pa.array(np.arange(0, P.size + 1, P.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:len(keys)], pa.ListArray.from_arrays(ends, pa.array(P.ravel()))],
                                                     names=schema.names)
        names = F.array(*[F.lit(t) for t in self.traits])
        return (x.mapInArrow(score, schema).select(*keys, F.posexplode("_p").alias("_k", "pred01"))
                .select(*keys, F.get(names, F.col("_k")).alias("trait"), "pred01"))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, k, float(self.bias[k]), [float(v) for v in self.weights[k]])
                for k, t in enumerate(self.traits)]
        return spark.createDataFrame(rows, "trait string, k int, bias double, weights array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Model files under ``path`` (weights as parquet, metadata JSON)."""
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        meta = {"traits": list(self.traits), "best_epoch": self.best_epoch, "best_val_loss": self.best_val_loss}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TraitScorer":
        rows = sorted(spark.read.parquet(f"{path}/weights").collect(), key=lambda r: r["k"])
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls([r["trait"] for r in rows], np.array([r["weights"] for r in rows]),
                   np.array([r["bias"] for r in rows]), meta["best_epoch"], meta["best_val_loss"])


def label_frame(essays: DataFrame, keys=("essay_id", "split"), traits=TRAITS) -> DataFrame:
    """C3 in wide form: one ``labels`` array (one 0..1 value per trait)."""
    return essays.select(*keys, F.array(*[label01(F.col(q(rater_col(1, t))), F.col(q(rater_col(2, t))))
                                          for t in traits]).alias("labels"))


def _list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose rows have ``width`` numbers, as a matrix (null: NaN)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def byte_matrix(column: pa.Array) -> np.ndarray:
    """A column of ``packed_rows`` as a matrix over the bytes that it holds."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.float64, count=(ends[-1] - ends[0]) // 8, offset=ends[0]).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if rows.num_rows:
            out = rows.columns[:-2]
            for c in rows.columns[-2:]:
                X = np.ascontiguousarray(_list_matrix(c, len(c.flatten()) // len(c)))
                if np.isnan(X).any():
                    raise ValueError("a feature or label of a training or validation row is missing")
                ends = np.arange(len(c) + 1, dtype=np.int32) * np.int32(8 * X.shape[1])
                out.append(pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(X)]))
            yield pa.RecordBatch.from_arrays(out, names=rows.schema.names)


def packed_rows(frame: DataFrame, keys, features_col: str = "features") -> DataFrame:
    """(keys, _x, labels) with features and labels as the bytes of doubles."""
    rows = frame.select(*keys, vector_to_array(features_col).alias("_x"), F.col("labels").cast("array<double>").alias("labels"))
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("_x", T.BinaryType()), T.StructField("labels", T.BinaryType())])
    return rows.mapInArrow(_pack, schema)


def packed_sizes(rows: DataFrame) -> tuple[int, int]:
    """Numbers of features and of traits of packed training rows."""
    first = rows.select(F.length("_x").alias("d"), F.length("labels").alias("t")).first()
    if first is None:
        raise ValueError("no training rows")
    return int(first["d"]) // 8, int(first["t"]) // 8


def _epoch_sums(data: DataFrame, W: np.ndarray, b: np.ndarray, train_split: str):
    """One pass: gradient sums on train rows, squared-error sums on train and
    valid rows, all at the current weights."""
    n_t = W.shape[0]

    def stats(batches):
        G = np.zeros_like(W)
        gb = np.zeros_like(b)
        s = np.zeros(4)  # train sse, train n, valid sse, valid n
        for rows in batches:
            if not rows.num_rows:
                continue
            X, Y = byte_matrix(rows.column(1)), byte_matrix(rows.column(2))
            P = 1.0 / (1.0 + np.exp(-(X @ W.T + b)))
            E = P - Y
            tr = pc.equal(rows.column(0), train_split).to_numpy(zero_copy_only=False)
            s += [(E[tr] ** 2).sum(), tr.sum(), (E[~tr] ** 2).sum(), (~tr).sum()]
            dZ = 2.0 * E * P * (1.0 - P) * tr[:, None]  # no copy of the training rows of X
            G += dZ.T @ X
            gb += dZ.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([G.ravel(), gb, s])])], names=["v"])

    out = data.mapInArrow(stats, "v array<double>")
    total = out.select(Summarizer.sum(array_to_vector("v")).alias("s")).first()["s"].toArray()
    G = total[: W.size].reshape(W.shape)
    gb = total[W.size: W.size + n_t]
    sse_tr, n_tr, sse_va, n_va = total[W.size + n_t:]
    return G, gb, sse_tr, n_tr, sse_va, n_va


def fit_scorer(frame: DataFrame, cfg: ScorerConfig | None = None, run_id: str = "run",
               features_col: str = "features") -> tuple[TraitScorer, DataFrame]:
    """fit on ``cfg.train_split`` rows, early-stop on ``cfg.valid_split``.

    ``frame`` has ``split``, a ``features`` vector and ``labels`` (one 0..1
    value per trait).  Returns the scorer with the best epoch's weights and
    the epoch history (run_id, epoch, train_loss, val_loss) as a DataFrame,
    ready for ``history.early_stopping``."""
    cfg = cfg or ScorerConfig()
    spark = frame.sparkSession
    # read once per epoch: the narrow training rows are written to shared
    # storage, so a lost executor re-reads them instead of re-running encoding
    # and pooling, and removed when the fit ends
    rows = packed_rows(frame.where(F.col("split").isin(cfg.train_split, cfg.valid_split)), ["split"], features_col)
    path = f"{shared_dir(spark)}/scorer-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    data = spark.read.schema(rows.schema).parquet(path).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(data, cfg, run_id)
    finally:
        data.unpersist()
        drop_path(spark, path)


def _fit(data: DataFrame, cfg: ScorerConfig, run_id: str) -> tuple[TraitScorer, DataFrame]:
    dim, n_t = packed_sizes(data.where(F.col("split") == cfg.train_split))
    rng = np.random.default_rng(cfg.seed)
    W = rng.standard_normal((n_t, dim)) * cfg.init_scale
    b = np.zeros(n_t)
    mW, vW, mb, vb = np.zeros_like(W), np.zeros_like(W), np.zeros_like(b), np.zeros_like(b)
    best = None  # (validation loss, weights, bias, epoch)
    history = []
    G, gb, sse_tr, n_tr, _, _ = _epoch_sums(data, W, b, cfg.train_split)
    for epoch in range(cfg.epochs):
        denom = max(n_tr, 1.0) * n_t
        train_loss = sse_tr / denom
        t = epoch + 1
        for p, g, m, v in ((W, G / denom, mW, vW), (b, gb / denom, mb, vb)):
            m *= cfg.beta1
            m += (1 - cfg.beta1) * g
            v *= cfg.beta2
            v += (1 - cfg.beta2) * g * g
            p -= cfg.lr * (m / (1 - cfg.beta1 ** t)) / (np.sqrt(v / (1 - cfg.beta2 ** t)) + cfg.eps)
        # the next pass gives this epoch's validation loss and the next gradient
        G, gb, sse_tr, n_tr, sse_va, n_va = _epoch_sums(data, W, b, cfg.train_split)
        val_loss = sse_va / max(n_va * n_t, 1.0) if n_va else float("nan")
        history.append((run_id, epoch, float(train_loss), float(val_loss)))
        if val_loss < (best[0] if best else float("inf")):
            best = (val_loss, W.copy(), b.copy(), epoch)
        if epoch - (best[3] if best else -1) >= cfg.patience:
            break
    if best is None:
        if not history:
            raise ValueError("no epoch was run")
        warnings.warn(f"{run_id}: no epoch improved on the validation rows; the last epoch's weights are kept",
                      stacklevel=3)
        best = (history[-1][3], W, b, history[-1][1])
    spark = data.sparkSession
    hist = spark.createDataFrame(history, "run_id string, epoch bigint, train_loss double, val_loss double")
    return TraitScorer(list(cfg.traits)[:n_t], best[1], best[2], best[3], float(best[0])), hist
