"""Prefix trie of conversations by range minima over sorted LCPs.

Each distinct sequence of a conversation's first d turns (role and text) is a
node of depth d; the conversations that start with it are its members.  In
sorted order the members of a node are neighbours, so a node is an interval of
the order, and the trie is never built by insertion:

1. Turns become 128-bit digests, numbered within their conversation.
2. Conversations are cut into chunks of ``CHUNK`` turns, so that a row stays
   small however long a conversation is.  A chunk knows all before it by a
   128-bit key (the XOR of the keys of its full chunks), and rows are sorted by
   (chunk number, key of what went before, digests, ended first, conv_id).
3. The order is cut into parts of bounded size.  Each part also gets its
   neighbours' border rows, so the LCP of every row with the one before is
   known.  A sparse table over the LCPs answers range minima at once, and each
   candidate prefix (a row and a depth) finds its left and its right extent by
   two independent binary searches: no stack, no order of work.  Members, subtree
   leaves and subtree sums are differences of prefix sums over the interval.
4. Only nodes that a border cuts (at most ``CHUNK`` at each border) are added
   up across parts, and only children across a border or a chunk end look
   their parent up by its key.

SHA-256 of a node's ended members is taken in its part; where a border cuts
the run, the parts give the joined ids as pieces and one task streams them.

Defined results: rows without conv_id take no part; turns go by number, nulls
first, ties by a digest of role and text; null role or text is empty; repeated
rows are repeated turns; conversations without turns are members of the root
only; other columns are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm.common import Scratch

CHUNK = 64
PART_ROWS = 50_000
PIECE_IDS = 8_192
DIGEST_BYTES = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_LONGS = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "said", "once", "ka", "kb", "parent_conv_id", "pa", "pb"]
NODE = T.StructType([*[T.StructField(c, T.LongType()) for c in _LONGS], T.StructField("cut", T.BooleanType()),
                     T.StructField("ends_sha256", T.StringType())])
PIECE = T.StructType([T.StructField("part", T.LongType()), T.StructField("no", T.LongType()),
                      T.StructField("piece", T.BinaryType())])


# ---- running sums over parts -----------------------------------------------

def before(rows: DataFrame, group: str, order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each ``out: (column, "sum" or "bit_xor")`` the aggregate over
    earlier rows of the group (0 if none).  Rows lie range-ordered by (group,
    order) in numbered parts (``part``): windows run within a part, and the
    totals of earlier parts, one row per group and part, are added, so a group
    of any size is many small windows."""
    inner = Window.partitionBy(group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fn = {"sum": F.sum, "bit_xor": F.bit_xor}
    none = F.lit(0).cast("bigint")
    totals = rows.groupBy(group, "part").agg(*[fn[f](c).alias(f"t_{o}") for o, (c, f) in values.items()])
    totals = totals.select(group, "part", *[F.coalesce(fn[f](f"t_{o}").over(outer), none).alias(f"t_{o}")
                                            for o, (c, f) in values.items()])
    out = rows.select("*", *[F.coalesce(fn[f](c).over(inner), none).alias(o) for o, (c, f) in values.items()]).join(
        totals, [group, "part"])
    for o, (_, f) in values.items():
        out = out.withColumn(o, F.col(o) + F.col(f"t_{o}") if f == "sum" else F.col(o).bitwiseXOR(F.col(f"t_{o}")))
    return out.drop("part", *[f"t_{o}" for o in values])


def parted(rows: DataFrame, *order) -> DataFrame:
    """``rows`` (a written table) dealt to range-ordered, numbered parts."""
    return rows.repartitionByRange(max(1, -(-rows.count() // PART_ROWS)), *order).withColumn("part", F.spark_partition_id())


# ---- turns --------------------------------------------------------------------

def numbered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of each conversation numbered
    from 1, as 128-bit digests of role and text, with the code points of the
    text.  Texts are read here and nowhere else."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.length(text).cast("bigint").alias("chars"), F.lit(1).cast("bigint").alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    said = scratch.write(said, "turns")
    said = scratch.write(parted(said, F.col("conv_id"), *order), "ordered")
    out = scratch.write(before(said, "conv_id", order, {"earlier": ("one", "sum")})
                        .select("conv_id", (F.col("earlier") + 1).alias("pos"), "digest", "chars"), "numbered")
    scratch.drop("turns", "ordered")
    return out


# ---- chunks -------------------------------------------------------------------

def key_of(j: int, digests: bytes) -> tuple[int, int]:
    """128-bit key of a chunk's (first) turns as two signed 64-bit numbers."""
    h = xxhash.xxh3_128_digest(j.to_bytes(8, "little") + digests)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [key_of(j, d) for j, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             b.column(3)], names=["conv_id", "j", "a", "b", "said"])


def chunks(numbered: DataFrame, totals: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, j, pa, pb, digests, chars, more, tail): a conversation's turns
    in chunks; (pa, pb) keys all before the chunk, ``more`` says whether turns
    follow it, and ``tail`` counts their code points."""
    j = F.floor((F.col("pos") - 1) / CHUNK).cast("bigint")
    rows = (numbered.groupBy("conv_id", j.alias("j"))  # at most CHUNK rows each
            .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
            .select("conv_id", "j", F.expr("unhex(array_join(transform(t, x -> hex(x.digest)), ''))").alias("digests"),
                    F.expr("transform(t, x -> x.chars)").alias("chars")))
    rows = scratch.write(rows.join(totals, "conv_id")
                         .withColumn("more", F.col("total") > (F.col("j") + 1) * CHUNK), "chunks")
    long = (rows.filter(F.col("total") > CHUNK)
            .select("conv_id", "j", "digests", F.expr("aggregate(chars, 0L, (s, x) -> s + x)").alias("said")))
    long = scratch.write(long.mapInArrow(_chunk_keys, "conv_id bigint, j bigint, a bigint, b bigint, said bigint"), "long")
    prefix = before(scratch.write(parted(long, "conv_id", "j"), "long-parts"), "conv_id", ["j"],
                    {"pa": ("a", "bit_xor"), "pb": ("b", "bit_xor"), "earlier": ("said", "sum")})
    whole = long.groupBy("conv_id").agg(F.sum("said").alias("whole"))
    prefix = prefix.join(whole, "conv_id").select("conv_id", "j", "pa", "pb", (F.col("whole") - F.col("earlier") - F.col("said")).alias("tail"))
    none = F.lit(0).cast("bigint")
    return rows.drop("total").join(prefix, ["conv_id", "j"], "left").select(
        "conv_id", "j", F.coalesce("pa", none).alias("pa"), F.coalesce("pb", none).alias("pb"), "digests", "chars", "more",
        F.coalesce("tail", none).alias("tail"))


_ORDER = ["j", "pa", "pb", "digests", "more", "conv_id"]


def _with_borders(rows: DataFrame) -> DataFrame:
    """``rows`` of numbered parts with, for each part, the last row of the part
    before (side -1) and the first of the next (side 1), sorted for a task."""
    ends = rows.groupBy("part").agg(F.min(F.struct(*_ORDER)).alias("lo"), F.max(F.struct(*_ORDER)).alias("hi"))
    order = Window.orderBy("part")  # one row a part
    near = ends.select("part", F.lag("hi").over(order).alias("l"), F.lead("lo").over(order).alias("r"))
    ghost = near.select("part", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("l").alias("x")),
                                                  F.struct(F.lit(1).alias("side"), F.col("r").alias("x")))).alias("g"))
    ghost = ghost.select("part", "g.side", "g.x.*").filter("j is not null")
    both = rows.withColumn("side", F.lit(0)).unionByName(ghost, allowMissingColumns=True)
    return both.repartition("part").sortWithinPartitions("part", "side", *_ORDER)


# ---- a part: LCPs, sparse tables, extents ----------------------------------------

def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading digests that both have."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (n - (x.bit_length() + 7) // 8) // DIGEST_BYTES


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all ranges of 1, 2, 4, ... values."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        last, w = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-w], last[w:]))
    return table


def range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] (inclusive) of each pair of bounds."""
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=table[0].dtype)
    for level in np.unique(k).tolist():
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[level][lo[at]], table[level][hi[at] - (1 << level) + 1])
    return out


def right_extent(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last row r >= row with min(lcp[row + 1 .. r]) >= depth; ``table`` is over
    lcp[1..n-1], the LCPs of rows with the row before."""
    r, most = row.copy(), len(table[0]) if table else 0
    for k in range(len(table) - 1, -1, -1):
        ok = r + (1 << k) <= most
        ok[ok] = table[k][r[ok]] >= depth[ok]
        r[ok] += 1 << k
    return r


def left_extent(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First row l <= row with min(lcp[l + 1 .. row]) >= depth."""
    left = row.copy()
    for k in range(len(table) - 1, -1, -1):
        ok = left - (1 << k) >= 0
        ok[ok] = table[k][left[ok] - (1 << k)] >= depth[ok]
        left[ok] -= 1 << k
    return left


class Part:
    """The rows of a part, sorted, with their LCPs and sparse tables."""

    def __init__(self, rows: list[tuple], left: tuple | None, right: tuple | None):
        self.rows = rows
        n = self.n = len(rows)
        size = self.size = np.array([len(r[3]) // DIGEST_BYTES for r in rows], dtype=np.int64)
        near = [left, *rows, right]
        same = lambda a, b: common_turns(a[3], b[3]) if a and b and a[:3] == b[:3] else 0
        self.lcp = np.array([same(a, b) for a, b in zip(near[:-1], near[1:])], dtype=np.int64)
        self.table = sparse_table(self.lcp[1:n]) if n > 1 else []
        self.conv = np.array([r[5] for r in rows], dtype=np.int64)
        self.more = np.array([r[4] for r in rows], dtype=bool)
        self.base = np.cumsum(size + 1) - size - 1  # place of C(0) of a row
        self.cum = np.zeros(int((size + 1).sum()), dtype=np.int64)
        for r, at in zip(rows, self.base.tolist()):
            np.cumsum(r[6], out=self.cum[at + 1:at + 1 + len(r[6])])
        self.all = self.cum[self.base + size]
        self.tail = np.array([r[7] for r in rows], dtype=np.int64)
        # each prefix is first seen in one row of the whole order, each leaf last
        self.first_said = self.all - self.cum[self.base + self.lcp[:n]]
        self.leaf = (~self.more & (self.lcp[1:] < size)).astype(np.int64)

    def own(self) -> Iterator[tuple]:
        """(conv_id, j, code points of prefixes first seen here, leaves)."""
        for r, s, leaf in zip(self.rows, self.first_said.tolist(), self.leaf.tolist()):
            yield r[5], r[0], s, leaf

    def nodes(self, chunk: int, piece_ids: int) -> tuple[dict[str, list], list[tuple]]:
        """Columns of NODE for the nodes of the part, and pieces of the ids of
        ended members as (ka, kb, no, bytes) where a border cuts a node."""
        n, lcp, size, cum, base = self.n, self.lcp, self.size, self.cum, self.base
        once = self.first_said + np.array([r[8] for r in self.rows], dtype=np.int64)
        leaves = self.leaf + np.array([r[9] for r in self.rows], dtype=np.int64)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        sum_said, sum_once, sum_leaves = total(self.all + self.tail), total(once), total(leaves)
        # candidates: depths above the LCP with the row before, and for the first row all that it has
        start = lcp[:n].copy()
        start[0] = 0
        many = size - start
        at = np.cumsum(many) - many
        row = np.repeat(np.arange(n), many)
        depth = np.arange(len(row)) - at[row] + start[row] + 1
        lo, hi = left_extent(self.table, row, depth), right_extent(self.table, row, depth)
        cut_l, cut_r = (lo == 0) & (lcp[0] >= depth), (hi == n - 1) & (lcp[n] >= depth)
        cut = cut_l | cut_r
        low = range_min(sparse_table(self.conv), lo, hi)
        above = cum[base[row] + depth - 1]
        n_convs = hi - lo + 1
        said = sum_said[hi + 1] - sum_said[lo] - n_convs * above
        seen = sum_once[hi + 1] - sum_once[lo + 1] + once[lo] - (cum[base[lo] + np.maximum(depth - 1, lcp[lo])] - cum[base[lo] + lcp[lo]])
        n_leaves = sum_leaves[hi + 1] - sum_leaves[lo]
        # the parent: one turn less, from its own left extent
        inner = np.flatnonzero(depth > 1)
        up = left_extent(self.table, row[inner], depth[inner] - 1)
        parent = np.full(len(row), -1)
        parent[inner] = at[up] + depth[inner] - 1 - start[up] - 1
        children = np.zeros(len(row), dtype=np.int64)
        new = inner[depth[inner] > lcp[row[inner]]]
        np.add.at(children, parent[new], 1)
        known = (parent >= 0) & ~cut[parent]
        # ended members lead the interval: equal rows without more turns
        same = np.zeros(n + 1, dtype=bool)
        same[1:n] = (lcp[1:n] == size[1:]) & (size[1:] == size[:-1]) & ~self.more[1:] & ~self.more[:-1]
        last = np.flatnonzero(~same[1:])
        run_end = last[np.searchsorted(last, np.arange(n))]
        ended = (size[lo] == depth) & ~self.more[lo]
        ids = self.conv.astype("U20").tolist() if ended.any() else []
        sha: list[str | None] = [NO_ENDS] * len(row)
        pieces: list[tuple] = []
        keyed = cut | (depth == chunk)
        keys: dict[int, tuple[int, int]] = {}
        for i in np.unique(np.concatenate([np.flatnonzero(keyed), parent[(parent >= 0) & ~known]])).tolist():
            r = self.rows[row[i]]
            a, b = key_of(r[0], r[3][:int(depth[i]) * DIGEST_BYTES])
            keys[i] = r[1] ^ a, r[2] ^ b
        for i in np.flatnonzero(ended).tolist():
            x, y = int(lo[i]), int(run_end[lo[i]]) + 1
            if cut[i]:
                sha[i] = None
                pieces += [(*keys[i], no, ",".join(ids[k:min(k + piece_ids, y)]).encode())
                           for no, k in enumerate(range(x, y, piece_ids))]
            else:
                sha[i] = hashlib.sha256(",".join(ids[x:y]).encode()).hexdigest()
        none = (None, None)
        key = [keys[i] if k else none for i, k in enumerate(keyed.tolist())]
        above_key = [none if k else (keys[p] if p >= 0 else self.rows[r][1:3])
                     for k, p, r in zip(known.tolist(), parent.tolist(), row.tolist())]
        j = np.array([r[0] for r in self.rows], dtype=np.int64)[row]
        return {"depth": (j * chunk + depth).tolist(), "conv_id": low.tolist(), "n_convs": n_convs.tolist(), "n_children": children.tolist(),
                "n_leaves": n_leaves.tolist(), "said": said.tolist(), "once": seen.tolist(), "ka": [k[0] for k in key],
                "kb": [k[1] for k in key], "parent_conv_id": [int(low[p]) if k else None for p, k in zip(parent.tolist(), known.tolist())],
                "pa": [k[0] for k in above_key], "pb": [k[1] for k in above_key], "cut": cut.tolist(), "ends_sha256": sha}, pieces


_COLUMNS = ["j", "pa", "pb", "digests", "more", "conv_id", "chars", "tail"]


def _parts(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[int, Part]]:
    """The parts of a task; one part's rows are held at a time."""
    now, rows, left, right = None, [], None, None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("part", "side", *_COLUMNS, *extra)]
        for part, side, *r in zip(*columns):
            if part != now:
                if rows:
                    yield now, Part(rows, left, right)
                now, rows, left, right = part, [], None, None
            if side == 0:
                rows.append(tuple(r))
            elif side < 0:
                left = tuple(r)
            else:
                right = tuple(r)
    if rows:
        yield now, Part(rows, left, right)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, part in _parts(batches, []):
        out = list(zip(*part.own()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["conv_id", "j", "once", "leaves"])


def _node_maker(chunk: int, piece_ids: int):
    schema = pa.schema([*[(c, pa.int64()) for c in _LONGS], ("cut", pa.bool_()), ("ends_sha256", pa.string()),
                        ("part", pa.int64()), ("no", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in _parts(batches, ["x_once", "x_leaves"]):
            columns, pieces = part.nodes(chunk, piece_ids)
            n, m = len(columns["cut"]), len(pieces)
            columns = {c: v + [None] * m for c, v in columns.items()}
            columns["ka"][n:], columns["kb"][n:] = [p[0] for p in pieces], [p[1] for p in pieces]
            columns["part"], columns["no"] = [None] * n + [k] * m, [None] * n + [p[2] for p in pieces]
            columns["piece"] = [None] * n + [p[3] for p in pieces]
            yield pa.RecordBatch.from_pydict(columns, schema)
    return run


def _stream_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by node and place; one hash state is held."""
    now, h, done = None, None, []
    for b in batches:
        for ka, kb, piece in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "piece"))):
            if (ka, kb) != now:
                if h:
                    done.append((*now, h.hexdigest()))
                now, h = (ka, kb), hashlib.sha256(piece)
            else:
                h.update(b"," + piece)
    if h:
        done.append((*now, h.hexdigest()))
    yield pa.RecordBatch.from_pydict({"ka": pa.array([d[0] for d in done], pa.int64()), "kb": pa.array([d[1] for d in done], pa.int64()),
                                      "sha": pa.array([d[2] for d in done], pa.string())})


def streamed_sha(pieces: DataFrame) -> DataFrame:
    """(ka, kb, sha) over the comma-joined pieces of each key."""
    return (pieces.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "part", "no")
            .mapInArrow(_stream_sha, "ka bigint, kb bigint, sha string"))


def _id_pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for b in batches:
            ids, part = b.column("conv_id").to_pylist(), b.column("part")
            cuts = range(0, len(ids), size)
            yield pa.RecordBatch.from_pydict({
                "ka": pa.array([0] * len(cuts), pa.int64()), "kb": pa.array([0] * len(cuts), pa.int64()),
                "part": pa.array([part[k].as_py() for k in cuts], pa.int64()), "no": pa.array([no + k for k in cuts], pa.int64()),
                "piece": pa.array([",".join(map(str, ids[k:k + size])).encode() for k in cuts], pa.binary())})
            no += len(ids)
    return run


# ---- the trie -------------------------------------------------------------------

def trie(numbered: DataFrame, totals: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the conversations of ``totals`` (conv_id, total: number of
    turns) with turns ``numbered`` (conv_id, pos, digest, chars).

    Per node: conv_id (smallest member), depth, parent_conv_id (the parent's
    conv_id), n_convs, n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (code points that the subtree's nodes need not repeat:
    (n_convs - 1) times those of a node's last turn, summed), ends_sha256 (of
    the ids of members without a further turn, ascending, comma-joined)."""
    none = F.lit(0).cast("bigint")
    root = totals.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not root[1]:
        return totals.sparkSession.createDataFrame([], schema)
    rows = scratch.write(chunks(numbered, totals, scratch), "keyed")
    rows = scratch.write(parted(rows, *_ORDER), "sorted")

    # of conversations of several chunks: what later chunks add to a subtree
    own = _with_borders(rows.filter("j >= 1")).mapInArrow(_own, "conv_id bigint, j bigint, once bigint, leaves bigint")
    own = scratch.write(own, "own")
    own = own.unionByName(own.select("conv_id").distinct().select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in ("j", "once", "leaves")]))
    run = before(scratch.write(parted(scratch.write(own, "own-all"), "conv_id", "j"), "own-parts"), "conv_id", ["j"],
                 {"b_once": ("once", "sum"), "b_leaves": ("leaves", "sum")})
    whole = own.groupBy("conv_id").agg(F.sum("once").alias("w_once"), F.sum("leaves").alias("w_leaves"))
    extra = run.join(whole, "conv_id").select("conv_id", "j", *[(F.col(f"w_{c}") - F.col(f"b_{c}") - F.col(c)).alias(f"x_{c}") for c in ("once", "leaves")])

    rows = rows.join(extra, ["conv_id", "j"], "left").withColumns({c: F.coalesce(c, none) for c in ("x_once", "x_leaves")})
    found = scratch.write(_with_borders(rows).mapInArrow(_node_maker(CHUNK, PIECE_IDS), T.StructType(NODE.fields + PIECE.fields)), "nodes")

    # nodes that borders cut
    nodes = found.filter("piece is null").drop("part", "no", "piece")
    turnless = parted(scratch.write(totals.filter("total = 0").select("conv_id"), "turnless"), "conv_id")
    shas = scratch.write(streamed_sha(
        found.filter("piece is not null").select("ka", "kb", "part", "no", "piece").unionByName(
            turnless.sortWithinPartitions("conv_id").mapInArrow(_id_pieces(PIECE_IDS), "ka bigint, kb bigint, part bigint, no bigint, piece binary"))), "shas")
    cut = (nodes.filter("cut").groupBy("ka", "kb")
           .agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"),
                F.max("pa").alias("pa"), F.max("pb").alias("pb"),
                *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "said", "once")])
           .join(shas, ["ka", "kb"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha"))
    nodes = scratch.write(nodes.filter("not cut").drop("cut").unionByName(cut), "whole")
    scratch.drop("chunks", "long", "long-parts", "keyed", "sorted", "own", "own-all", "own-parts", "nodes", "turnless")

    # across chunk ends: children of a chunk's last turn; across borders: parents
    end = F.col("depth") % CHUNK == 0
    across = (nodes.filter((F.col("depth") > 1) & ((F.col("depth") - 1) % CHUNK == 0))
              .groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({"pa": "ka", "pb": "kb"}))
    parents = nodes.filter("ka is not null").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("p"))
    nodes = nodes.filter(~end).unionByName(
        nodes.filter(end).join(across, ["ka", "kb"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("c", none)).drop("c"))
    lost = F.col("parent_conv_id").isNull() & (F.col("depth") > 1)
    nodes = nodes.filter(~lost).unionByName(
        nodes.filter(lost).join(parents, ["pa", "pb"]).withColumn("parent_conv_id", F.col("p")).drop("p"))

    top = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                                        F.sum(F.col("said") - F.col("once")).alias("saved"))
    sha = shas.filter("ka = 0 and kb = 0").first()
    top = top.select(
        F.lit(root[0]).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(root[1]).alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce("saved", none).alias("saved_tokens"), F.lit(sha["sha"] if sha else NO_ENDS).alias("ends_sha256"))
    return nodes.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(root[0])).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", (F.col("said") - F.col("once")).alias("saved_tokens"), "ends_sha256").unionByName(top)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The nodes (see ``trie``) of a table (conv_id, turn, role, text)."""
    scratch = Scratch(turns.sparkSession, "prefix-trie")
    numbered = numbered_turns(turns, scratch)
    return trie(numbered, numbered.groupBy("conv_id").agg(F.max("pos").alias("total")), scratch)


def with_openings(numbered: DataFrame, scratch: Scratch, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings, as (numbered turns, totals): with
    h = crc32(decimal conv_id) % ``most``, conversation c starts with the first
    h turns of conversation c - c % ``every`` and goes on with its own turns
    after its first h.  A shared opening is at most ``most`` - 1 turns, taken
    by at most ``every`` conversations (on either side of zero)."""
    own = numbered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    lead = numbered.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    size = lead.groupBy("base").agg(F.max("pos").alias("n_base"))
    convs = (own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most)
             .withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(size, "base", "left")
             .withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint")))))
    convs = scratch.write(convs.select("conv_id", "base", "h", "taken", (
        F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")
    given = convs.join(lead, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", "pos", "digest", "chars")
    kept = (numbered.join(convs.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") > F.col("h"))
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars"))
    return scratch.write(given.unionByName(kept), "rebuilt"), convs.select("conv_id", "total")
