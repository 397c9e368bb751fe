"""Toxic spans and document scores by a linear-chain conditional random field.

Training (one bounded sample of at most ``SAMPLE_DOCS`` labelled documents of
each class, drawn by a hash of the id, fitted in one task):

1. Token labels come from document labels.  The word form or word beginning
   that best tells toxic from other documents (G-test of document frequencies)
   is marked, again and again, until every toxic document holds two marked
   words or no feature passes ``LEAST_G``.  Covering documents one feature at
   a time keeps the chance words of a copied document from being marked.
2. A two-state chain (0 other, 1 toxic) is fitted to these token labels:
   hashed word forms and beginnings score the states, four weights score
   state changes, by gradient steps on the exact sequence likelihood.
3. A logistic model maps a document's three largest marginals to its label.

Scoring runs on every whole text: forward-backward gives each token's marginal
of being toxic; chains are cut into segments of 64 tokens whose 2x2 products
are joined exactly, so a long document costs no more per token than short ones.

Defined results: null, empty and blank texts have no tokens and get the score
of a document without toxic tokens; repeated rows get equal results; labels of
one document that disagree count as toxic; without labelled documents of both
classes every score is 0; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm import bpe

SAMPLE_DOCS = 1_000
FEATURE_BITS = 18
BEGINNINGS = (3, 4, 5, 6)
LEAST_G = 20.0
SEGMENT = 64
EPOCHS = 4
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()),
                       T.StructField("n_toxic", T.IntegerType()), T.StructField("spans", SPAN)])
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"\S+")


# ---- features -----------------------------------------------------------------

def form(token: str) -> str:
    return _EDGE.sub("", token.lower())


def features(word: str) -> list[str]:
    """The word form and its beginnings."""
    return ["=" + word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for f in features(word)]


# ---- chain --------------------------------------------------------------------

def marginals(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray,
              want_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For chains laid end to end: each token's probability of state 1, and
    the sum over neighbouring tokens of the pair probabilities (2x2).

    ``odds`` are the log-odds that a token's features give to state 1, and
    ``trans`` the log weights of state changes."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    segs = -(-lengths // SEGMENT)
    first_seg = np.cumsum(segs) - segs
    n_seg = int(segs.sum())
    starts = np.cumsum(lengths) - lengths
    within = np.arange(n) - np.repeat(starts, lengths)
    cell = (np.repeat(first_seg, lengths) + within // SEGMENT) * SEGMENT + within % SEGMENT
    e = np.ones(n_seg * SEGMENT)
    e[cell] = np.exp(np.clip(odds, -30, 30))
    real = np.zeros(n_seg * SEGMENT, dtype=bool)
    real[cell] = True
    e, real = e.reshape(n_seg, SEGMENT).T.copy(), real.reshape(n_seg, SEGMENT).T.copy()
    t = np.exp(trans)
    head = np.zeros(n_seg, dtype=bool)
    head[first_seg[lengths > 0]] = True

    def step(a0, a1, j):
        """Forward weights after token j of every segment."""
        b0, b1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[j]
        if j == 0:  # nothing comes before the first token of a chain
            b0, b1 = np.where(head, a0, b0), np.where(head, a1 * e[0], b1)
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
        return np.where(real[j], b0, a0), np.where(real[j], b1, a1), s

    # products of whole segments: what state 0 or 1 before it becomes
    rows = []
    for a0, a1 in ((1.0, 0.0), (0.0, 1.0)):
        a0, a1, scale = np.full(n_seg, a0), np.full(n_seg, a1), np.zeros(n_seg)
        for j in range(SEGMENT):
            a0, a1, s = step(a0, a1, j)
            scale += np.where(real[j], np.log(s), 0.0)
        rows.append((a0, a1, scale))
    top = np.maximum(rows[0][2], rows[1][2])
    prod = np.empty((n_seg, 2, 2))
    for i, (a0, a1, scale) in enumerate(rows):
        f = np.exp(scale - top)
        prod[:, i, 0], prod[:, i, 1] = a0 * f, a1 * f

    # weights before every segment and behind it, chain by chain
    order = np.argsort(-segs, kind="stable")
    left = np.full((n_seg, 2), 0.5)
    right = np.full((n_seg, 2), 0.5)
    depth = int(segs.max())
    alive = [int((segs > k).sum()) for k in range(depth)]
    for k in range(1, depth):
        at = first_seg[order[:alive[k]]] + k
        v = np.einsum("ni,nij->nj", left[at - 1], prod[at - 1])
        left[at] = v / v.sum(axis=1, keepdims=True)
    last = first_seg + segs - 1
    for k in range(1, depth):
        at = last[order[:alive[k]]] - k
        v = np.einsum("nij,nj->ni", prod[at + 1], right[at + 1])
        right[at] = v / v.sum(axis=1, keepdims=True)

    fwd = np.empty((SEGMENT, n_seg))
    a0, a1 = left[:, 0].copy(), left[:, 1].copy()
    fore = []
    for j in range(SEGMENT):
        fore.append((a0, a1))
        a0, a1, _ = step(a0, a1, j)
        fwd[j] = a1
    b0, b1 = right[:, 0].copy(), right[:, 1].copy()
    p = np.empty((SEGMENT, n_seg))
    pairs = np.zeros((2, 2))
    for j in range(SEGMENT - 1, -1, -1):
        f1 = fwd[j]
        den = (1 - f1) * b0 + f1 * b1
        p[j] = f1 * b1 / den
        w0, w1 = b0, e[j] * b1
        if want_pairs:
            linked = real[j] & ~head if j == 0 else real[j]
            x0, x1 = fore[j]
            z = x0 * (t[0, 0] * w0 + t[0, 1] * w1) + x1 * (t[1, 0] * w0 + t[1, 1] * w1)
            z = np.where(linked, z, 1.0)
            for i, x in ((0, x0), (1, x1)):
                for k, w in ((0, w0), (1, w1)):
                    pairs[i, k] += (x * t[i, k] * w / z)[linked].sum()
        c0, c1 = t[0, 0] * w0 + t[0, 1] * w1, t[1, 0] * w0 + t[1, 1] * w1
        s = c0 + c1
        b0, b1 = np.where(real[j], c0 / s, b0), np.where(real[j], c1 / s, b1)
    return p.T.reshape(-1)[cell], pairs


# ---- training -------------------------------------------------------------------

def mark_words(docs: list[tuple[set[str], int]]) -> set[str]:
    """Features that mark toxic tokens (see the module text)."""
    n = Counter(y for _, y in docs)
    if not n[0] or not n[1]:
        return set()
    freq = {0: Counter(), 1: Counter()}
    sets = []
    holders = defaultdict(list)
    for i, (words, y) in enumerate(docs):
        fs = {f for w in words for f in features(w)} if y else None
        if y:
            sets.append((i, fs))
            for f in fs:
                holders[f].append(len(sets) - 1)
            freq[1].update(fs)
    wanted = {f for f, c in freq[1].items() if c >= 3}
    for words, y in docs:
        if not y:
            freq[0].update({f for w in words for f in features(w)} & wanted)

    def g(f: str) -> float:
        a, b = freq[1][f], freq[0][f]
        if a * n[0] <= b * n[1]:
            return 0.0
        share = (a + b) / (n[0] + n[1])
        return 2 * (a * np.log(a / (n[1] * share)) + (b * np.log(b / (n[0] * share)) if b else 0.0))

    score = {f: g(f) for f in wanted}
    marked: set[str] = set()
    found: dict[int, set[str]] = defaultdict(set)
    covered: set[int] = set()
    while score:
        best = max(score, key=lambda f: (score[f], f[0] == "=", len(f), f))
        if score[best] < LEAST_G:
            break
        del score[best]
        marked.add(best)
        for s in holders[best]:
            i, fs = sets[s]
            found[s] |= {w for w in docs[i][0] if best in features(w)}
            if len(found[s]) >= 2 and s not in covered:
                covered.add(s)
                for f in fs:
                    freq[1][f] -= 1
                    if f in score:
                        score[f] = g(f)
    return marked


def fit_model(texts: list[str], labels: list[int]) -> dict | None:
    """The model of a sample, or None without documents of both classes."""
    words = [[form(t) for t in x.split()] for x in texts]
    marked = mark_words([(set(w), y) for w, y in zip(words, labels)])
    if not marked:
        return None
    known: dict[str, tuple[int, list[int]]] = {}
    for w in {x for ws in words for x in ws}:
        known[w] = (int(any(f in marked for f in features(w))), slots(w))
    # texts of several hundred tokens, toxic and other in turn
    order = sorted(range(len(words)), key=lambda i: zlib.crc32(str(i).encode()))
    weight = np.zeros(1 << FEATURE_BITS)
    square = np.full(1 << FEATURE_BITS, 1e-6)
    bias, trans = -4.0, np.zeros((2, 2))
    b_square, t_square = 1.0, np.ones((2, 2))
    rate = 0.5
    for _ in range(EPOCHS):
        for lo in range(0, len(order), 100):
            part = [i for i in order[lo:lo + 100] if words[i]]
            flat = [known[w] for i in part for w in words[i]]
            if not flat:
                continue
            lengths = np.array([len(words[i]) for i in part])
            y = np.fromiter((k for k, _ in flat), dtype=np.int64, count=len(flat)) * np.repeat([labels[i] for i in part], lengths)
            size = np.fromiter((len(s) for _, s in flat), dtype=np.int64, count=len(flat))
            at = np.repeat(np.arange(len(flat)), size)
            slot = np.fromiter((x for _, s in flat for x in s), dtype=np.int64, count=int(size.sum()))
            odds = bias + np.bincount(at, weights=weight[slot], minlength=len(flat))
            p, pairs = marginals(odds, lengths, trans)
            err = p - y
            grad = np.bincount(slot, weights=err[at], minlength=len(weight))
            hit = np.flatnonzero(grad)
            square[hit] += grad[hit] ** 2
            weight[hit] -= rate * grad[hit] / np.sqrt(square[hit])
            weight[hit] *= 1 - 1e-3
            d = err.sum()
            b_square += d * d
            bias -= rate * d / np.sqrt(b_square)
            first = np.cumsum(lengths) - lengths
            inner = np.ones(len(y), dtype=bool)
            inner[first] = False
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            dt = pairs - seen
            t_square += dt * dt
            trans -= rate * dt / np.sqrt(t_square)
    model = {"weight": weight.astype(np.float32), "bias": float(bias), "trans": trans, "calibration": None}
    x = np.array([summary(p) for p in document_marginals(texts, model)])
    model["calibration"] = fit_logistic(x, np.array(labels, dtype=float))
    return model


def summary(p: np.ndarray) -> tuple[float, ...]:
    """What a document's score depends on: 1 and its three largest marginals
    (a sum over all tokens would grow with the length of a clean text)."""
    top = np.zeros(3)
    best = p if len(p) <= 3 else np.partition(p, len(p) - 3)[-3:]
    top[:len(best)] = np.sort(best)[::-1]
    return (1.0, *top.tolist())


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


# ---- scoring --------------------------------------------------------------------

def _odds_memo(model: dict) -> bpe.ChunkMemo:
    w, bias = model["weight"], model["bias"]
    return bpe.ChunkMemo(lambda tokens: [bias + float(sum(w[s] for s in slots(form(t)))) for t in tokens])


def document_marginals(texts: list[str], model: dict, memo: bpe.ChunkMemo | None = None) -> Iterator[np.ndarray]:
    """Marginals of the tokens (between white space) of each text."""
    memo = memo or _odds_memo(model)
    for part in bpe.sub_batches(texts):
        words = [t.split() for t in part]
        known = memo.values(set().union(*words)).__getitem__
        lengths = np.array([len(w) for w in words])
        odds = np.fromiter(map(known, chain.from_iterable(words)), dtype=float, count=int(lengths.sum()))
        p, _ = marginals(odds, lengths, model["trans"], want_pairs=False)
        yield from np.split(p, np.cumsum(lengths)[:-1])


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Character spans of runs of tokens that are toxic more likely than not."""
    out: list[dict] = []
    joined = -2
    for k, m in enumerate(_TOKEN.finditer(text)):
        if p[k] >= 0.5:
            if joined == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            joined = k
    return out


def _scorer(blob: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(blob) if blob else None
        memo = _odds_memo(model) if model else None
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            score, count, where = [], [], []
            if model:
                for t, p in zip(texts, document_marginals(texts, model, memo)):
                    z = float(np.dot(summary(p), model["calibration"]))
                    score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                    count.append(int((p >= 0.5).sum()))
                    where.append(spans(t, p) if count[-1] else [])
            else:
                score, count, where = [0.0] * len(texts), [0] * len(texts), [[] for _ in texts]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int32()),
                                              pa.array(where, kind)], names=SCORED.names)
    return run


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for b in batches:
        texts += [t or "" for t in b.column(0).to_pylist()]
        labels += b.column(1).to_pylist()
    model = fit_model(texts, labels) if texts else None
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model) if model else None], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> bytes | None:
    """A pickled model from at most ``sample_docs`` documents of each class of
    ``labels`` (doc_id, toxic); equal texts count once."""
    known = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [known.filter(F.col("toxic") == y).orderBy(*order).limit(sample_docs) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample_docs rows
    sample = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    found = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text").mapInArrow(_fit_task, "model binary").collect()
    return bytes(found[0]["model"]) if found and found[0]["model"] is not None else None


def score(docs: DataFrame, model: bytes | None) -> DataFrame:
    """(doc_id, score, n_toxic, spans) of every row: probability of the toxic
    label, number of toxic tokens, their character spans in the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scorer(model), SCORED)
