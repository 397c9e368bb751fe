"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most ``capacity`` ids.  Only the histogram
of piece lengths (at most ``capacity`` rows, whatever the input) reaches the
driver.  There a covering program over configurations (multisets of lengths
that fit a sequence) is solved by multiplicative weights, each step priced by
a knapsack dynamic program, and rounded to whole copies as they are bought.
The program ends when it covers all but ``GAP`` of the ids; the pieces of that
remainder go best-fit decreasing.  Pieces are then ranked within their length
on Spark and each rank looks up its place in the plan.

Defined results: null text counts as empty; every document has at least one
piece (the end id alone); repeated rows are packed each for itself; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm import bpe
from kappaflow.llm.common import Scratch, forgetting

END_ID = b"\0\0\0\0"
PIECE_FIELDS = [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                T.StructField("ids", T.BinaryType())]
RANK_BUCKET_ROWS = 5_000
GAP = 0.02
MEMO_CHUNKS = 800_000
CUT_DOCS = 1000
_ENCODERS: dict[str, "Encoder"] = {}


# ---- tokens ---------------------------------------------------------------

class Encoder:
    """Ids of whole texts as a byte-level tokenizer of the library gives them
    without added special tokens, as little-endian unsigned 32-bit bytes.

    A single space between two characters that are not white space starts a
    token, so texts are cut there.  Unknown words are encoded many at a time,
    joined by such spaces: a token begins with the byte of the space exactly
    where a word begins."""

    def __init__(self, path: str):
        self.tok = bpe.load(path)
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # byte 0x20
        self.first = bpe.ChunkMemo(self.each, 50_000, bpe.odd)
        self.later = bpe.ChunkMemo(self.joined, MEMO_CHUNKS, bpe.odd)

    def each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def joined(self, words: list[str], together: int = 50) -> list[bytes]:
        """Ids of each word with a space in front."""
        texts = [" " + " ".join(words[i:i + together]) for i in range(0, len(words), together)]
        raw = b"".join(self.each(texts))
        cuts = np.flatnonzero(self.starts[np.frombuffer(raw, dtype="<u4")])
        if len(cuts) != len(words):
            return self.each([" " + w for w in words])
        ends = [*(cuts * 4).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def by_gaps(self, text: str) -> bytes:
        """A text with other white space next to its spaces."""
        head, *rest = bpe.GAP.split(text)
        plain = self.later.values({c for c in rest if " " not in c})
        return b"".join([*self.each([head]), *(plain[c] if c in plain else self.each([" " + c])[0] for c in rest)])

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        for part in bpe.sub_batches(texts):
            words = [t.split(" ") for t in part]
            heads = self.first.values({w[0] for w in words})
            known = self.later.values(set().union(*(w[1:] for w in words))).__getitem__
            for t, w in zip(part, words):
                try:
                    ids = heads[w[0]] + b"".join(map(known, w[1:]))
                except KeyError:
                    ids = self.by_gaps(t)
                yield ids


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """The memos of all encoders; tokenizers stay."""
    for e in _ENCODERS.values():
        e.first.clear()
        e.later.clear()


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    return encoder(path).texts(texts)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all full but
    the first, which holds the rest."""
    head = n - capacity * ((n - 1) // capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def _cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, CUT_DOCS) for b in batches for i in range(0, b.num_rows, CUT_DOCS)):
            doc_ids = b.column(0).to_pylist()
            texts = [t or "" for t in b.column(1).to_pylist()]
            cols: list[list] = [[], [], [], [], []]
            for d, ids in zip(doc_ids, encode_texts(texts, path)):
                stored = np.frombuffer(ids + END_ID, dtype="<u4")
                if len(encoder(path).starts) <= 1 << 16:
                    stored = stored.astype("<u2")
                for k, (start, length) in enumerate(piece_bounds(len(stored), capacity)):
                    for col, v in zip(cols, (d, k, start, length, stored[start:start + length].tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                names=[f.name for f in PIECE_FIELDS])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids): token pieces with their ids as
    little-endian unsigned binary, of 16 bits an id where the whole vocabulary
    fits and of 32 bits otherwise."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        forgetting(_cutter(tokenizer_path, capacity), _forget), T.StructType(PIECE_FIELDS))


def wide(ids: pa.Array, n: int) -> pa.Array:
    """``ids`` of 16 or 32 bits, ``n`` in all, as 32-bit binary."""
    at = np.frombuffer(ids.buffers()[1], dtype="<i4")[ids.offset:ids.offset + len(ids) + 1]
    if at[-1] - at[0] == 4 * n:
        return ids
    values = np.frombuffer(ids.buffers()[2], dtype="<u2", count=n, offset=int(at[0])).astype("<u4")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(((at - at[0]) * 2).astype("<i4")), pa.py_buffer(values)])


# ---- plan (driver, bounded by capacity) -------------------------------------

def price(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for every room up to
    ``capacity`` the highest total price and the item to put in first (-1: a
    place stays empty)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        total = prices[:k] + best[c - lengths[:k]]
        j = int(total.argmax())
        if total[j] > best[c - 1]:
            best[c], choice[c] = total[j], j
        else:
            best[c] = best[c - 1]
    return best, choice


def full_configuration(first: int, lengths: np.ndarray, choice: np.ndarray, capacity: int) -> dict[int, int]:
    """Item -> pieces of the best configuration that holds item ``first``;
    empty where that leaves room."""
    out = {first: 1}
    c = capacity - int(lengths[first])
    while c > 0:
        j = int(choice[c])
        if j < 0:
            return {}
        out[j] = out.get(j, 0) + 1
        c -= int(lengths[j])
    return out


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int = 400,
                          rate: float = 0.1, share: float = 0.5, slack: float = 0.1,
                          gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """(configuration, copies) pairs that cover ``counts`` up to ``gap`` of
    the ids and never more than is there.

    Prices start at each length's share of a sequence, a little more for long
    pieces, which are harder to place.  One knapsack a step prices, for every
    length, the best configuration that holds it.  Those within ``slack`` of
    the best price that fill a sequence are bought, whole copies up to
    ``share`` of what is left of their scarcest length.  Then the price of
    each length goes down by the factor exp(-rate * share of it covered), and
    a little where configurations asked for more of it than is left."""
    prices = (lengths / capacity) ** 1.02
    left = counts.copy()
    open_ids = int((lengths * counts).sum())
    most_open = gap * open_ids
    bought: dict[tuple, int] = {}
    for _ in range(steps):
        live = np.flatnonzero(left > 0)
        if open_ids <= most_open:
            break
        here = lengths[live]
        best, choice = price(here, prices[live], capacity)
        value = prices[live] + best[capacity - here]
        covered = np.zeros(len(lengths))
        short = np.zeros(len(lengths), dtype=bool)
        for j in np.argsort(-value, kind="stable").tolist():
            if value[j] < (1 - slack) * best[capacity]:
                break
            conf = full_configuration(j, here, choice, capacity)
            if not conf:
                continue  # best-fit fills what the program would leave open
            js = live[list(conf)]
            a = np.array(list(conf.values()), dtype=np.int64)
            fit = int((left[js] // a).min())
            if not fit:
                short[js[left[js] < a]] = True
                continue
            n = max(1, int(share * fit))
            left[js] -= n * a
            covered[js] += n * a
            open_ids -= n * capacity
            key = tuple(sorted(zip(lengths[js].tolist(), a.tolist())))
            bought[key] = bought.get(key, 0) + n
        if not covered.any() and not short.any():
            break
        prices *= np.exp(-rate * (covered / counts + 0.2 * short))
    return [(dict(k), n) for k, n in bought.items()]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: equal open sequences are handled
    together, so the work depends on the number of lengths, not of pieces."""
    room: dict[int, list[list]] = {}

    def put(conf: dict[int, int], free: int, n: int) -> None:
        if n:
            room.setdefault(free, []).append([conf, n])

    for length, n in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        while n:
            free = min((r for r in room if r >= length), default=capacity)
            group = room.get(free)
            conf, have = group.pop() if group else ({}, -(-n // (capacity // length)))
            if group is not None and not group:
                del room[free]
            each = free // length
            whole = min(have, n // each)
            rest = n - whole * each if whole < have else 0
            rest = min(rest, each)
            put(conf | {length: conf.get(length, 0) + each}, free - each * length, whole)
            if rest:
                put(conf | {length: conf.get(length, 0) + rest}, free - rest * length, 1)
            if conf:
                put(conf, free, have - whole - bool(rest))
            n -= whole * each + rest
    return [(conf, n) for groups in room.values() for conf, n in groups]


def plan(histogram: dict[int, int], capacity: int, steps: int = 400) -> list[tuple[dict[int, int], int]]:
    """(configuration, copies) pairs that hold every piece exactly once: the
    rounded program, and best-fit for the pieces that it leaves."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    if not len(lengths):
        return []
    full = lengths == capacity  # a sequence each
    packed = [({capacity: 1}, int(n)) for n in counts[full]]
    lengths, counts = lengths[~full], counts[~full]
    if len(lengths):
        left = dict(zip(lengths.tolist(), counts.tolist()))
        for conf, n in configuration_program(lengths, counts, capacity, steps):
            packed.append((conf, n))
            for length, k in conf.items():
                left[length] -= n * k
        rest = np.array([(x, n) for x, n in left.items() if n], dtype=np.int64).reshape(-1, 2)
        packed += best_fit(rest[:, 0], rest[:, 1], capacity)
    return packed


def plan_slots(packed: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, pieces per sequence, first sequence, offset)
    arrays, in the order of ranks."""
    rows: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    seq = 0
    for conf, n in packed:
        offset = 0
        for length, k in sorted(conf.items(), reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), k, seq, offset))
            used[length] = used.get(length, 0) + k * n
            offset += k * length
        seq += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in rows.items()}


# ---- placement on Spark -----------------------------------------------------

def ranked(pieces: DataFrame, n_rows: int) -> DataFrame:
    """``pieces`` (uid, length, ...) with the 0-based rank of each piece among
    those of its length.

    A length that holds many pieces is ranked in buckets of about
    ``RANK_BUCKET_ROWS`` rows of all lengths; the counts of earlier buckets
    are added from the table of bucket counts."""
    buckets = max(1, -(-n_rows // RANK_BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
             .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("length", "bucket").orderBy("uid")
    return (rows.withColumn("rank", F.row_number().over(within) - 1)
            .join(bases, ["length", "bucket"])
            .withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base"))


def _placer(slots: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq = np.zeros(len(length), dtype=np.int64)
            off = np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                n = int(length[part[0]])
                first, each, seq0, off0 = slots[n]
                j = np.searchsorted(first, rank[part], side="right") - 1
                at = rank[part] - first[j]
                seq[part] = seq0[j] + at // each[j]
                off[part] = off0[j] + at % each[j] * n
            kept = [c for c in b.schema.names if c not in ("rank", "uid")]
            cols = [wide(b.column(c), int(length.sum())) if c == "ids" else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(seq), pa.array(off)], names=kept + ["sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, steps: int = 400) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id,
    offset; ids are little-endian unsigned 32-bit binary.  Pieces of a
    sequence lie without gaps from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer_path, capacity)
                           .withColumn("uid", F.monotonically_increasing_id()), "pieces")
    histogram = {int(r["length"]): int(r["n"])
                 for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_slots(plan(histogram, capacity, steps))
    rows = ranked(pieces, sum(histogram.values()))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("rank", "uid")]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(_placer(slots), schema).select(
        *[f.name for f in PIECE_FIELDS], "sequence_id", "offset")
