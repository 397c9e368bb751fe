"""Mini-batch training of the trait scorer (F1 with F4, F7, F9).

Every epoch shuffles the training essays with its own seed into batches
(``history.train_batch_ids``) and takes one Adam step per batch, in batch
order, on the mean squared error of the 0..1 labels.  The gradients of
``batches_per_pass`` consecutive batches are taken at the weights before the
first of them: with one batch a pass every step uses the weights of the step
before; with more, gradients are up to a pass old.

Steps follow each other, so passes cannot run side by side; instead an epoch
costs one shuffle and one read of the rows, however many passes it has.  Every
epoch deals the rows into segments of consecutive passes, ``SEGMENT_BYTES`` of
rows each, and one Spark job per segment takes its steps inside a task that
streams its rows in batch order.  Model and Adam state go from segment to
segment over the driver; rows never do.

The loss of an epoch is the mean of its batches' losses, on the validation
rows too (evaluation batches in essay order); training stops after
``patience`` epochs without a strictly lower one, and the best epoch's weights
are kept.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaflow.operators import history as H
from kappaflow.operators.scorer import ScorerConfig, TraitScorer, byte_matrix, packed_rows, packed_sizes
from kappaflow.schema import ESSAY_BATCH
from kappaflow.session import drop_path, shared_dir

SEGMENT_BYTES = 64 << 20


@dataclass
class MinibatchConfig(ScorerConfig):
    lr: float = 0.02
    batch_size: int = ESSAY_BATCH["train"]
    batches_per_pass: int = 8


class Adam:
    """Adam over a list of arrays, updated in place."""

    def __init__(self, params: list[np.ndarray], cfg: ScorerConfig):
        self.params, self.cfg, self.t = params, cfg, 0
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in "mv")

    def step(self, grads: list[np.ndarray]) -> None:
        c = self.cfg
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += (1 - c.beta1) * (g - m)
            v += (1 - c.beta2) * (g * g - v)
            p -= c.lr * (m / (1 - c.beta1 ** self.t)) / (np.sqrt(v / (1 - c.beta2 ** self.t)) + c.eps)


def _passes(batches: Iterator[pa.RecordBatch], per_pass: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(batch numbers, features, labels) of every pass; rows come in batch order."""
    held: list[tuple] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        k, X, Y = rows.column(0).to_numpy(), byte_matrix(rows.column(1)), byte_matrix(rows.column(2))
        cuts = [0, *(np.flatnonzero(np.diff(k // per_pass)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0][0][0] // per_pass != k[lo] // per_pass:
                yield tuple(map(np.concatenate, zip(*held)))
                held = []
            held.append((k[lo:hi], X[lo:hi], Y[lo:hi]))
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def segment_steps(rows: DataFrame, adam: Adam, per_pass: int) -> tuple[float, int]:
    """The Adam steps of the batches of ``rows`` (one segment: batch, _x,
    labels), taken in batch order by one task from the state of ``adam``, which
    is left as after the last step.  Returns the sum of the batches' mean
    losses and the number of batches."""
    def run(batches):
        W, b = adam.params
        total, count = 0.0, 0
        for k, X, Y in _passes(batches, per_pass):
            P = 1.0 / (1.0 + np.exp(-(X @ W.T + b)))
            E = P - Y
            Z = 2.0 * E * P * (1.0 - P)
            cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts, cuts[1:]):
                scale = (hi - lo) * len(b)
                adam.step([Z[lo:hi].T @ X[lo:hi] / scale, Z[lo:hi].sum(axis=0) / scale])
                total += float((E[lo:hi] ** 2).sum()) / scale
                count += 1
        state = np.concatenate([a.ravel() for a in (*adam.params, *adam.m, *adam.v)])
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count]), pa.array([adam.t]), pa.array([state.tobytes()])],
                                         names=["total", "n", "t", "state"])

    end = rows.coalesce(1).sortWithinPartitions("batch").select("batch", "_x", "labels").mapInArrow(
        run, "total double, n bigint, t bigint, state binary").first()
    if end is None or not end["n"]:
        return 0.0, 0
    state, at = np.frombuffer(end["state"]), 0
    for a in (*adam.params, *adam.m, *adam.v):
        a[...] = state[at:at + a.size].reshape(a.shape)
        at += a.size
    adam.t = end["t"]
    return end["total"], end["n"]


def batch_mean_loss(rows: DataFrame, W: np.ndarray, b: np.ndarray) -> float:
    """Mean over batches of the mean squared error of each."""
    def losses(frames):
        total: dict[int, np.ndarray] = {}
        for got in frames:
            if not got.num_rows:
                continue
            X, Y = byte_matrix(got.column(1)), byte_matrix(got.column(2))
            e = ((1.0 / (1.0 + np.exp(-(X @ W.T + b))) - Y) ** 2).mean(axis=1)
            ks, at = np.unique(got.column(0).to_numpy(), return_inverse=True)
            for k, x, n in zip(ks.tolist(), np.bincount(at, weights=e), np.bincount(at)):
                total[k] = total.get(k, 0.0) + np.array([x, n])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t[0] for t in total.values()]),
                                              pa.array([t[1] for t in total.values()])], names=["batch", "e", "n"])

    per = rows.select("batch", "_x", "labels").mapInArrow(losses, "batch bigint, e double, n double").groupBy("batch").agg((F.sum("e") / F.sum("n")).alias("m"))
    found = per.agg(F.avg("m")).first()[0]
    return float("nan") if found is None else float(found)


def fit_minibatch(frame: DataFrame, cfg: MinibatchConfig | None = None, run_id: str = "run",
                  features_col: str = "features") -> tuple[TraitScorer, DataFrame]:
    """fit on ``cfg.train_split`` rows of ``frame`` (essay_id, split,
    ``features``, ``labels``), stop early on ``cfg.valid_split``.  Returns the
    scorer with the best epoch's weights and the epoch history."""
    cfg = cfg or MinibatchConfig()
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/minibatch-{uuid.uuid4().hex}"
    rows = packed_rows(frame.where(F.col("split").isin(cfg.train_split, cfg.valid_split)), ["essay_id", "split"], features_col)
    rows.write.partitionBy("split").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(*rows.columns)
    # rows lie by the keys that every epoch joins its batch numbers on, so only these move for it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    train = rows.where(F.col("split") == cfg.train_split).repartition(parts, "essay_id", "split").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(train, rows.where(F.col("split") == cfg.valid_split), cfg, run_id, path)
    finally:
        train.unpersist()
        drop_path(spark, path)


def _fit(train: DataFrame, valid: DataFrame, cfg: MinibatchConfig, run_id: str, path: str) -> tuple[TraitScorer, DataFrame]:
    spark = train.sparkSession
    (dim, n_t), n = packed_sizes(train), train.count()
    valid.join(H.eval_batch_ids(valid, cfg.batch_size), ["essay_id", "split"]).write.parquet(f"{path}/valid-batches")
    valid = spark.read.parquet(f"{path}/valid-batches")
    W = np.random.default_rng(cfg.seed).standard_normal((n_t, dim)) * cfg.init_scale
    b = np.zeros(n_t)
    adam, best, history = Adam([W, b], cfg), None, []
    n_batches = -(-n // cfg.batch_size)
    pass_bytes = cfg.batches_per_pass * cfg.batch_size * 8 * (dim + n_t)
    per_segment = cfg.batches_per_pass * max(1, SEGMENT_BYTES // pass_bytes)
    for epoch in range(cfg.epochs):
        ids = H.train_batch_ids(train, cfg.batch_size, epoch, cfg.seed).select("essay_id", "split", "batch")
        dealt = (train.join(ids, ["essay_id", "split"])
                 .select("batch", "_x", "labels", F.floor(F.col("batch") / F.lit(per_segment)).cast("int").alias("segment")))
        dealt.repartition("segment").sortWithinPartitions("segment", "batch").write.partitionBy("segment").parquet(f"{path}/epoch-{epoch}")
        dealt = spark.read.schema(dealt.schema).parquet(f"{path}/epoch-{epoch}")
        done = [segment_steps(dealt.where(F.col("segment") == k), adam, cfg.batches_per_pass)
                for k in range(-(-n_batches // per_segment))]
        drop_path(spark, f"{path}/epoch-{epoch}")
        steps = sum(n for _, n in done)
        train_loss = sum(x for x, _ in done) / steps if steps else float("nan")
        val_loss = batch_mean_loss(valid, W, b)
        history.append((run_id, epoch, train_loss, val_loss))
        if val_loss < (best[0] if best else float("inf")):
            best = (val_loss, W.copy(), b.copy(), epoch)
        if epoch - (best[3] if best else -1) >= cfg.patience:
            break
    if not history:
        raise ValueError("no epoch was run")
    if best is None:
        warnings.warn(f"{run_id}: no epoch improved on the validation rows; the last epoch's weights are kept", stacklevel=3)
        best = (history[-1][3], W, b, history[-1][1])
    hist = spark.createDataFrame(history, "run_id string, epoch bigint, train_loss double, val_loss double")
    return TraitScorer(list(cfg.traits)[:n_t], best[1], best[2], best[3], float(best[0])), hist
