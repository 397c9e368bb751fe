"""Approximate nearest neighbours by an adaptive dimension scan.

Unit vectors are turned by one random orthogonal matrix and dealt to lists by
their nearest centroid (spherical k-means on a sample of at most
``SAMPLE_ROWS`` vectors; every vector is indexed, in as many lists as the root
of their number, up to one per sampled vector).  A query visits the
``PROBE_SHARE`` nearest lists, nearest first: a first wave scans the nearest
``FIRST_SHARE`` of all lists, and the distance of its k-th best found so far
is the bound against which the second wave, over the other lists, abandons.

Within a block of a list, distances grow by blocks of ``COLUMN_BLOCK`` turned
columns.  After d of D columns a candidate no farther than the bound shows a
share of its squared distance that, under a random rotation, has the
distribution Beta(d/2, (D-d)/2); a candidate whose partial distance lies above
the 1 - ``ERROR`` quantile of it times the bound is abandoned.  Only survivors
get their exact cosine on the original vectors.

Lists are split into blocks of about ``BLOCK_ROWS`` candidates and chunks of
``BLOCK_ROWS`` queries, so a list that holds a third of all vectors is spread
over many tasks; a block's candidates are the only rows held in memory.

Defined results: vectors that are null, zero, of another length than ``dim``
or that hold null, NaN or infinite components take no part, nor do rows
without id; a query's own id is no candidate; equal scores go to the smaller
id; of rows that share an id each is a candidate, and pairs of queries that
share an id are ranked together; fewer candidates than asked for give fewer
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm.common import Scratch

SAMPLE_ROWS = 20_000
PROBE_SHARE = 0.75
FIRST_SHARE = 0.05
BLOCK_ROWS = 4_096
BATCH_PAIRS = 131_072
COLUMN_BLOCK = 8
ERROR = 0.005
TINY = 1e-9
SEED = 7


def usable(vectors: DataFrame, dim: int, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; floats stay floats, all else
    becomes doubles (tasks compute in double precision)."""
    kind = vectors.schema[vector].dataType
    stored = "array<float>" if isinstance(kind, T.ArrayType) and kind.elementType == T.FloatType() else "array<double>"
    ok = ("vec_id is not null and size(v) = {d} and forall(v, x -> x is not null and not isnan(x) "
          "and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)").format(d=dim)
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"),
                          F.col(vector).cast(stored).alias("v")).filter(ok)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an empty centroid keeps its place."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), size=min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of two matrices row by row, in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (x * q).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
    odd = ~np.isfinite(s)
    if odd.any():  # squares out of range: scale first
        s[odd] = (_unit(x[odd]) * _unit(q[odd])).sum(axis=1)
    return s


@cache
def abandon_shares(dim: int, step: int, error: float) -> dict[int, float]:
    """Columns read -> the share of its squared distance that a candidate has
    shown by then with probability 1 - ``error`` at most (1 after all)."""
    t = np.linspace(0, 1, 100_001)[1:-1]
    shares = {dim: 1.0}
    for d in range(step, dim, step):
        log_density = (d / 2 - 1) * np.log(t) + ((dim - d) / 2 - 1) * np.log1p(-t)
        below = np.exp(log_density - log_density.max()).cumsum()
        shares[d] = float(t[np.searchsorted(below, (1 - error) * below[-1])])
    return shares


def scan_block(queries: np.ndarray, turned_q: np.ndarray, own: np.ndarray, bound: np.ndarray, ids: np.ndarray,
               x: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query rows, ids, scores) of the best ``k`` of a block for each query,
    among candidates within its ``bound`` (a squared distance of unit
    vectors), and the number of column values read."""
    dim = turned.shape[1]
    shares = abandon_shares(dim, COLUMN_BLOCK, ERROR)
    d = min(COLUMN_BLOCK, dim)
    part = ((turned_q[:, :d] ** 2).sum(axis=1)[:, None] + (turned[:, :d] ** 2).sum(axis=1)[None, :]
            - 2 * turned_q[:, :d] @ turned[:, :d].T)
    part[own[:, None] == ids[None, :]] = np.inf
    read = part.size * d
    open_ = np.flatnonzero(np.isinf(bound))
    if len(open_) and len(ids) > k + 1:  # k candidates that look near bound the k-th best of the block
        lead = np.argpartition(part[open_], k - 1, axis=1)[:, :k]
        full = ((turned[lead] - turned_q[open_][:, None, :]) ** 2).sum(axis=2)
        full[np.isinf(np.take_along_axis(part[open_], lead, axis=1))] = np.inf
        bound = bound.copy()
        bound[open_] = full.max(axis=1)
    qi, ci = np.nonzero((part <= shares[d] * bound[:, None] + TINY) & np.isfinite(part))
    dist = part[qi, ci]
    for at in range(d, dim, COLUMN_BLOCK):
        nxt = min(at + COLUMN_BLOCK, dim)
        read += len(qi) * (nxt - at)
        dist = dist + ((turned[ci, at:nxt] - turned_q[qi, at:nxt]) ** 2).sum(axis=1)
        stay = dist <= shares[nxt] * bound[qi] + TINY
        qi, ci, dist = qi[stay], ci[stay], dist[stay]
    score = exact_cosine(queries[qi], x[ci])
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[best], ids[ci[best]], score[best], read


def _assigner(cent: np.ndarray, dim: int):
    """Adds the list of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_unit(_matrix(b.column(1), dim)) @ cent.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))],
                                                 names=["vec_id", "v", "list"])
    return run


def _prober(cent: np.ndarray, dim: int, probes: int):
    """Adds the ``probes`` nearest lists of every vector, nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = _unit(_matrix(b.column(1), dim)) @ cent.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "v", "near"])
    return run


def _scanner(turn: np.ndarray, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs = None, [], []
        block = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("list", "part", "chunk")], axis=1)
            is_q = b.column("is_query").to_numpy()
            vid, v = b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim)
            bound = b.column("bound").to_numpy()
            change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(is_q) != 0)) + 1
            edges = [0, *change.tolist(), len(vid)]
            out: list[list] = [[], [], []]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                now = tuple(keys[lo])
                if not is_q[lo]:
                    if now != key:
                        key, ids, vecs = now, [], []
                    ids.append(vid[lo:hi])
                    vecs.append(v[lo:hi])
                    block = None
                    continue
                if now != key:
                    continue  # a block without candidates
                if block is None:
                    x = np.concatenate(vecs)
                    block = (np.concatenate(ids), x, _unit(x) @ turn)
                together = max(1, BATCH_PAIRS // len(block[0]))
                for s in range(lo, hi, together):
                    e = min(hi, s + together)
                    rows, found, score, _ = scan_block(v[s:e], _unit(v[s:e]) @ turn, vid[s:e], bound[s:e], *block, k)
                    out[0].append(vid[s + rows])
                    out[1].append(found)
                    out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: str, k: int = 5, dim: int = 64, vec_id: str = "vec_id",
            vector: str = "embedding", probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row
    that satisfies the SQL condition ``queries`` on vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "dimension-scan")
    rows = usable(vectors, dim, vec_id, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = rows.count()
    fit = _unit(np.array([r[0] for r in sample], dtype=np.float64))
    cent = centroids(fit, math.isqrt(n))
    probes, first = math.ceil(probe_share * len(cent)), math.ceil(FIRST_SHARE * len(cent))
    kind = rows.schema["v"].dataType.simpleString()
    held = scratch.write(rows.mapInArrow(_assigner(cent, dim), f"vec_id bigint, v {kind}, list int"), "lists")
    asked = scratch.write(rows.filter(queries).mapInArrow(
        _prober(cent, dim, probes), f"vec_id bigint, v {kind}, near array<int>"), "queries")
    parts = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    parts = scratch.write(parts, "parts")
    turn = rotation(dim)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def scan(wave: DataFrame) -> DataFrame:
        """Best pairs of a wave (vec_id, v, bound, list): blocks of each
        list's candidates times chunks of its queries."""
        chunks = wave.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("chunks"))
        size = F.broadcast(parts.join(chunks, "list"))  # one row per list
        mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = held.join(size, "list").select("list", mine("parts").alias("part"), every("chunks").alias("chunk"),
                                           F.lit(0).alias("is_query"), "vec_id", "v", F.lit(0.0).alias("bound"))
        q = wave.join(size, "list").select("list", every("parts").alias("part"), mine("chunks").alias("chunk"),
                                           F.lit(1).alias("is_query"), "vec_id", "v", "bound")
        return (a.unionByName(q).repartition("list", "part", "chunk")
                .sortWithinPartitions("list", "part", "chunk", "is_query")
                .mapInArrow(_scanner(turn, dim, k), "query_id bigint, vec_id bigint, score double"))

    def best(found: DataFrame) -> DataFrame:
        return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    near = asked.select("vec_id", "v", F.lit(math.inf).alias("bound"), F.explode(F.slice("near", 1, first)).alias("list"))
    lead = scratch.write(best(scan(near)), "first")
    if probes <= first:
        return lead
    bounds = lead.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("bound"))
    rest = (asked.join(bounds, "vec_id", "left")
            .select("vec_id", "v", F.coalesce("bound", F.lit(math.inf)).alias("bound"),
                    F.explode(F.slice("near", first + 1, probes - first)).alias("list")))
    return best(scan(rest).unionByName(lead.drop("rank")))
