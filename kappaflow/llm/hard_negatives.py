"""Hard-negative mining with segment summary filtering.

Vectors become integers (floor of ``scale`` times a component) and a row's
score is its integer inner product with an anchor.  An anchor's positives are
its ``positives`` best rows of its own label; for each positive, rows of other
labels whose score lies between ``low`` and ``high`` per cent of the
positive's are hard negatives, and the best ``negatives`` of them are taken.

Every vector is cut into segments, halved from level to level, and stored with
each segment's mean m and deviation d (the norm of what is left without the
mean).  For two vectors x, y and segments of length L the inner product lies
within  sum(L * mx * my) +- sum(dx * dy).  A task holds a chunk of anchors and
streams a group of rows; each anchor keeps its best rows so far, which gives
the least score that still matters.  Pairs whose bounds miss it (or the band)
are dropped level by level, coarse segments first; only what survives all
levels is scored exactly.  Bounds carry a slack above all rounding errors, so
nothing is lost.

Both passes meet every anchor with every row it may take (rows of its label,
or all rows), in blocks: chunks of about ``ANCHOR_CHUNK`` anchors times groups
of about ``GROUP_ROWS`` rows.  A label, vector or anchor that holds a third of
all rows is many blocks.

Defined results: rows without id or label, vectors that are null, of another
length than ``dim`` or hold null, NaN or infinite components take no part, nor
do vectors with an integer above ``MOST`` in size, whose scores would not fit
in 64 bits; of several rows with one id the one with the smallest (label,
vector) counts; equal scores go to the smaller id; an anchor without positives
or a positive without negatives in its band gives no row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kappaflow.llm.common import Scratch

ANCHOR_CHUNK = 4_096
GROUP_ROWS = 8_192
ANCHOR_BLOCK = 1_024
ROW_BLOCK = 2_048
FIRST_BLOCK = 256
SPARSE_SHARE = 0.2
PAIR_BLOCK = 100_000
MOST = 1 << 27
SLACK = 1e-3  # squared: relative to the product of norms
NONE = np.iinfo(np.int64).min


# ---- summaries ------------------------------------------------------------------

def levels(dim: int) -> list[np.ndarray]:
    """Segment bounds of each level: halved down to two components; every
    second level and the finest are used."""
    bounds = [np.array([0, dim])]
    while (np.diff(bounds[-1]) > 3).any() or (len(bounds) == 1 and dim > 2):
        b = bounds[-1]
        bounds.append(np.unique(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return [b for t, b in enumerate(bounds) if t % 2 == 0 or t == len(bounds) - 1]


def summaries(x: np.ndarray, dim: int) -> np.ndarray:
    """Per row, for each level: sqrt(length) * mean, then deviation, of every
    segment."""
    out = []
    for b in levels(dim):
        size = np.diff(b)
        mean = np.add.reduceat(x, b[:-1], axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        out += [mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, b[:-1], axis=1))]
    return np.concatenate(out, axis=1).astype("<f4")


def _quantiser(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.floor(b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * scale)
            ok = np.flatnonzero((np.abs(x) <= MOST).all(axis=1))
            rows = pa.array(ok)
            q = [r.tobytes() for r in x[ok].astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(q, pa.binary())],
                                             names=["vec_id", "label", "q"])
    return run


def _summariser(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = summaries(_integers(b.column("q").to_pylist(), dim), dim)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in s], pa.binary())],
                                                 names=[*b.schema.names, "s"])
    return run


def _integers(q: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(q), dtype="<i4").reshape(-1, dim).astype(np.float64)


def summary_index(vectors: DataFrame, dim: int, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
                  label: str = "label") -> DataFrame:
    """(vec_id, label, q, s): integer vectors and their segment summaries."""
    ok = ("vec_id is not null and label is not null and size(v) = {d} and "
          "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))").format(d=dim)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                          F.col(vector).cast("array<double>").alias("v")).filter(ok)
    one = (rows.mapInArrow(_quantiser(dim, scale), "vec_id bigint, label bigint, q binary")
           .groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"))
    return one.mapInArrow(_summariser(dim), "vec_id bigint, label bigint, q binary, s binary")


# ---- a block of anchors against rows ----------------------------------------------

class Rows:
    """Ids, labels, integer vectors and summaries of some rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, s: np.ndarray, dim: int):
        self.ids, self.labels, self.x = ids, labels, x
        self.norm = np.sqrt((x * x).sum(axis=1))
        slack = (self.norm * SLACK)[:, None]
        self.mean, self.dev, at = [], [], 0
        for b in levels(dim):
            n = len(b) - 1
            self.mean.append(s[:, at:at + n].astype(np.float64))
            self.dev.append(np.concatenate([s[:, at + n:at + 2 * n], slack], axis=1))
            at += 2 * n

    def part(self, lo: int, hi: int) -> "Rows":
        out = object.__new__(Rows)
        out.ids, out.labels, out.x, out.norm = (v[lo:hi] for v in (self.ids, self.labels, self.x, self.norm))
        out.mean, out.dev = ([v[lo:hi] for v in w] for w in (self.mean, self.dev))
        return out


class Best:
    """The best ``k`` rows of each slot (an anchor and one of its bands) by
    score, then id; a band takes scores from ``low`` to ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        n = low.size
        self.score = np.full((n, k), NONE)
        self.ids = np.zeros((n, k), dtype=np.int64)

    def least(self) -> np.ndarray:
        """Least score that still matters, by anchor and band."""
        return np.maximum(self.low, self.score[:, -1].reshape(self.low.shape))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        seen = np.unique(slot)
        held = np.flatnonzero(self.score[seen].ravel() != NONE)
        slot = np.concatenate([np.repeat(seen, self.k)[held], slot])
        score = np.concatenate([self.score[seen].ravel()[held], score])
        ids = np.concatenate([self.ids[seen].ravel()[held], ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.score[slot[keep], rank[keep]], self.ids[slot[keep], rank[keep]] = score[keep], ids[keep]


def exact_scores(a: Rows, b: Rows, ai: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly below 2**53."""
    out = np.empty(len(ai), dtype=np.int64)
    wide = a.norm.max(initial=0) * b.norm.max(initial=0) < 2.0 ** 53
    x, y = (a.x, b.x) if wide else (a.x.astype(np.int64), b.x.astype(np.int64))
    for k in range(0, len(ai), PAIR_BLOCK):
        w = slice(k, k + PAIR_BLOCK)
        out[w] = np.einsum("ij,ij->i", x[ai[w]], y[bi[w]])
    return out


def surviving(a: Rows, b: Rows, may: np.ndarray, least: np.ndarray, high: np.ndarray, alive: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``may`` whose bounds reach one of the anchor's
    bands at every level; ``alive`` counts the pairs before each level."""
    bands = least.shape[1]
    pairs = None
    for t, (ma, da, mb, db) in enumerate(zip(a.mean, a.dev, b.mean, b.dev)):
        if pairs is None:
            alive[t] += int(may.sum())
            mid, off = ma @ mb.T, da @ db.T
            hi, lo = mid + off, mid - off
            ok = np.zeros_like(may)
            for j in range(bands):
                ok |= (hi >= least[:, j, None]) & (lo <= high[:, j, None])
            may = may & ok
            if may.mean() < SPARSE_SHARE or t == len(a.mean) - 1:
                pairs = np.nonzero(may)
        else:
            ai, bi = pairs
            alive[t] += len(ai)
            keep = np.zeros(len(ai), dtype=bool)
            for k in range(0, len(ai), PAIR_BLOCK):
                w = slice(k, k + PAIR_BLOCK)
                mid = np.einsum("ij,ij->i", ma[ai[w]], mb[bi[w]])
                off = np.einsum("ij,ij->i", da[ai[w]], db[bi[w]])
                keep[w] = ((mid + off >= least[ai[w]].T) & (mid - off <= high[ai[w]].T)).any(axis=0)
            pairs = ai[keep], bi[keep]
    alive[-1] += len(pairs[0])
    return pairs


def search(a: Rows, best: Best, rows: Rows, same_label: bool, alive: list[int]) -> None:
    """Takes ``rows`` into account for the anchors ``a``."""
    bands = best.low.shape[1]
    cuts = [0, *range(min(FIRST_BLOCK, len(rows.ids)), len(rows.ids), ROW_BLOCK), len(rows.ids)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        b = rows.part(lo, hi)
        for s in range(0, len(a.ids), ANCHOR_BLOCK):
            p = a.part(s, s + ANCHOR_BLOCK)
            may = (p.labels[:, None] == b.labels) == same_label
            may &= p.ids[:, None] != b.ids
            least, high = best.least()[s:s + ANCHOR_BLOCK], best.high[s:s + ANCHOR_BLOCK]
            ai, bi = surviving(p, b, may, least.astype(np.float64), high.astype(np.float64), alive)
            score = exact_scores(p, b, ai, bi)
            fits = (score[:, None] >= least[ai]) & (score[:, None] <= high[ai])
            at, band = np.nonzero(fits)
            if len(at):
                best.add((s + ai[at]) * bands + band, score[at], b.ids[bi[at]])


def _searcher(dim: int, k: int, bands: int, low: int, high: int, same_label: bool):
    """Rows come sorted by block with the block's anchors first; one block's
    anchors and one batch of rows are held at a time."""
    def bounds(positive: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
        if same_label:
            big = np.full((len(positive), 1), NONE)
            return big, -(big + 1)
        lo, hi = np.zeros((len(positive), bands), dtype=np.int64), np.full((len(positive), bands), NONE)
        for i, scores in enumerate(positive):
            for j, p in enumerate(scores):
                lo[i, j], hi[i, j] = -(-low * p // 100), high * p // 100
        return lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, anchors, best = None, [], None, None
        alive = [0] * (len(levels(dim)) + 1)

        def done() -> pa.RecordBatch:
            n, slots = (0, 0) if best is None else best.score.shape[::-1]
            slot, rank = np.nonzero(best.score != NONE) if best is not None else (np.zeros(0, int), np.zeros(0, int))
            width = 1 if best is None else best.low.shape[1]
            ids = anchors.ids[slot // width] if best is not None else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array((slot % width).astype(np.int32)),
                 pa.array(best.ids[slot, rank] if best is not None else np.zeros(0, np.int64)),
                 pa.array(best.score[slot, rank] if best is not None else np.zeros(0, np.int64))],
                names=["anchor_id", "band", "vec_id", "score"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("grp", "chunk", "part", "is_row")], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                c = b.slice(lo, hi - lo)
                key = tuple(keys[lo][:3])
                if key != now:
                    if best is not None:
                        yield done()
                    now, held, anchors, best = key, [], None, None
                rows = (c.column("vec_id").to_numpy(), c.column("label").to_numpy(), _integers(c.column("q").to_pylist(), dim),
                        np.frombuffer(b"".join(c.column("s").to_pylist()), dtype="<f4").reshape(hi - lo, -1))
                if not keys[lo][3]:
                    held.append((*rows, c.column("positive").to_pylist()))
                elif held or best is not None:
                    if best is None:
                        *columns, positive = zip(*held)
                        anchors = Rows(*(np.concatenate(x) for x in columns), dim)
                        best = Best(*bounds([p for ps in positive for p in ps]), k)
                        held = []
                    search(anchors, best, Rows(*rows, dim), same_label, alive)
        if best is not None:
            yield done()
    return run


# ---- on Spark -----------------------------------------------------------------

def _pairs(anchors: DataFrame, rows: DataFrame, run) -> DataFrame:
    """(anchor_id, band, vec_id, score) of every block's best rows; anchors
    and rows have the columns grp, chunks, parts (of the group)."""
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["vec_id", "label", "q", "s"]
    a = anchors.select("grp", mine("chunks").alias("chunk"), every("parts").alias("part"), F.lit(0).alias("is_row"), *cols, "positive")
    b = rows.select("grp", every("chunks").alias("chunk"), mine("parts").alias("part"), F.lit(1).alias("is_row"), *cols,
                    F.lit(None).cast("array<bigint>").alias("positive"))
    key = ["grp", "chunk", "part"]
    return (a.unionByName(b).repartition(*key).sortWithinPartitions(*key, "is_row")
            .mapInArrow(run, "anchor_id bigint, band int, vec_id bigint, score bigint"))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _count(n, size: int):
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, dim: int = 64,
         scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows that satisfy the SQL condition ``anchors`` on
    vec_id."""
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    index = scratch.write(summary_index(vectors, dim, scale, vec_id, vector, label), "index")
    asked = F.expr(anchors)

    # positives: blocks within a label (one row a label in ``sizes``)
    sizes = index.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("m"))
    sizes = scratch.write(sizes.filter("m > 0").select("label", _count(F.col("m"), ANCHOR_CHUNK).alias("chunks"),
                                                       _count(F.col("n"), GROUP_ROWS).alias("parts")), "sizes")
    rows = index.join(sizes, "label").withColumn("grp", F.col("label"))
    found = _pairs(rows.filter(asked).withColumn("positive", F.lit(None).cast("array<bigint>")), rows,
                   _searcher(dim, positives, 1, low, high, True))
    taken = scratch.write(_first(found, positives).select("anchor_id", F.col("vec_id").alias("positive_id"),
                                                          F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("band")), "positives")

    # negatives: all rows against all anchors with positives
    n, m = index.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks = {"grp": F.lit(0).cast("bigint"), "chunks": F.lit(max(1, -(-m // ANCHOR_CHUNK))), "parts": F.lit(max(1, -(-n // GROUP_ROWS)))}
    bands = taken.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("band", "positive_score"))).alias("p"))
    held = (index.filter(asked).join(bands.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_score").alias("positive")), "vec_id")
            .withColumns(blocks))
    found = _first(_pairs(held, index.withColumns(blocks), _searcher(dim, negatives, positives, low, high, False)), negatives)
    return (found.join(taken, ["anchor_id", "band"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
