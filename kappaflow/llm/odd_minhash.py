"""Near-duplicate documents by MinHash bands, odd sketches and exact sets.

A document's set holds its distinct shingles of five words (lower-cased A-Z,
words between ASCII white space); a document of fewer words has its whole
word sequence as one shingle.  Two documents are linked when
100 * |intersection| >= 75 * |union|.

1. One pass makes per document 128 MinHash samples, their 32 band keys and the
   odd sketch: each sample flips one of 256 bits, so the XOR of two sketches
   counts differing samples and estimates high similarities closely.
2. Documents of equal sets form one class; only classes go on.
3. Classes that share a band key are candidates.  Each key first links its
   members to one member (another one for each key); sketches drop pairs whose
   estimate lies more than five standard deviations below the threshold, the
   others are confirmed on full sets.
4. Where a key's members still lie in different components, all their pairs
   are compared on full sets, in blocks inside tasks that give out only links
   that join components.  So no link that matters is lost, and a large group
   of near copies never becomes rows of all its pairs.

A link at the threshold shares no band with probability (1 - 0.75**4)**32,
about 5e-6, and less above it.

Defined results: null or blank text has an empty set, is linked with nothing
and kept; repeated rows share a class; null doc_ids come last when a class
picks its smallest id; other columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm.common import Scratch, unsized
from kappaflow.llm.components import components

SHINGLE_WORDS = 5
LINK_PERCENT = 75
SAMPLES = 128
BAND_ROWS = 4
SKETCH_BITS = 256
LEAST_ESTIMATE = 0.4
CHUNK_MEMBERS = 64
BLOCK_NODES = 512
SUB_BATCH_BYTES = 2_000_000

_RNG = np.random.default_rng(20240607)
_FLIP = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SIGNATURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()),
    T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [(t or b"").lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=len(flat))
    n = max(0, len(h) - SHINGLE_WORDS + 1)
    s = h[:n].copy()
    for j in range(1, SHINGLE_WORDS):
        s = _mix(s) + h[j:n + j]
    s = _mix(s)
    out, at = [], 0
    for ws in words:
        k = len(ws)
        if k >= SHINGLE_WORDS:
            out.append(np.unique(s[at:at + k - SHINGLE_WORDS + 1]))
        elif k:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=k)], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += k
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(samples, sets) 32-bit minima; the sets must not be empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((SAMPLES, len(sets)), dtype=np.uint32)
    buf = np.empty_like(x)
    for j in range(SAMPLES):
        np.bitwise_xor(x, _FLIP[j], out=buf)
        np.multiply(buf, _TIMES[j], out=buf)
        out[j] = np.minimum.reduceat(buf, starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(bands, sets) 64-bit keys of ``BAND_ROWS`` consecutive samples."""
    rows = samples.astype(np.uint64).reshape(SAMPLES // BAND_ROWS, BAND_ROWS, -1)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)[:, None] * _MIX2
    for r in range(BAND_ROWS):
        key = _mix(key + rows[:, r, :])
    return key


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(sets, words) parity bitmaps: every sample flips one bit."""
    j = np.arange(SAMPLES, dtype=np.uint64)[:, None]
    bit = (_mix((samples.astype(np.uint64) << np.uint64(8)) + j) % np.uint64(SKETCH_BITS)).astype(np.int64)
    n = samples.shape[1]
    flips = np.bincount((bit + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS) & 1
    packed = np.packbits(flips.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little")
    return packed.view("<u8")


def most_odd_bits(least: float = LEAST_ESTIMATE) -> int:
    """The largest XOR population count whose similarity estimate
    1 + bits/(4*samples) * ln(1 - 2*count/bits) is at least ``least``."""
    return int(np.floor(SKETCH_BITS / 2 * (1 - np.exp(-(1 - least) * 4 * SAMPLES / SKETCH_BITS))))


def _byte_parts(texts: list[bytes | None]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= SUB_BATCH_BYTES:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        for part in _byte_parts(texts):
            sets = shingle_sets(texts[part])
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            if full:
                samples = min_hashes([sets[i] for i in full])
                bk = band_keys(samples).T.copy().view(np.int64)
                sk = odd_sketches(samples).view(np.int64)
                for row, i in enumerate(full):
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    bands[i], sketches[i] = bk[row], sk[row]
            n = part.stop - part.start
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(part.start, n), b.column(1).slice(part.start, n),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=SIGNATURE.names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text and its UTF-8 bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.unhex(F.md5(text)).alias("text_key"), text.cast("binary").alias("body"))


def signatures(docs: DataFrame) -> DataFrame:
    return _keyed(docs).mapInArrow(_signatures, SIGNATURE)


# ---- confirming candidates ----------------------------------------------------

def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= LINK_PERCENT * (len(a) + len(b) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group with the group's centre first; one centre set
    is held at a time."""
    group, centre = None, None
    for b in batches:
        rows = list(zip(b.column("hub").to_pylist(), b.column("chunk").to_pylist(),
                        b.column("is_hub").to_pylist(), b.column("node").to_pylist()))
        bodies = b.column("body").to_pylist()
        hits: list[tuple[int, int]] = []
        for part in _byte_parts(bodies):
            for (hub, chunk, is_hub, node), s in zip(rows[part], shingle_sets(bodies[part])):
                if is_hub:
                    group, centre = (hub, chunk), s
                elif group == (hub, chunk) and similar(centre, s):
                    hits.append((node, hub))
        yield _links(hits)


def confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough.

    Pairs are grouped by ``b``; a hub with many partners is split into chunks
    of about ``CHUNK_MEMBERS``, each with its own copy of the hub's text."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK_MEMBERS).cast("int").alias("chunks"))
    members = (pairs.join(sizes, "b")
               .select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"),
                       F.lit(0).alias("is_hub"), F.col("a").alias("node")))
    hubs = sizes.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                        F.lit(1).alias("is_hub"), F.col("b").alias("node"))
    rows = members.unionByName(hubs).join(unsized(bodies), "node")
    return (rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("is_hub").desc())
            .mapInArrow(_confirm, "a bigint, b bigint"))


def _link_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block pair; one pair's rows are held at a time."""
    names = ("family", "al", "ai", "bl", "bi")
    now, held = None, ([], [], [])
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in names)))
        hits: list[tuple[int, int]] = []
        for key, *row in zip(keys, *(b.column(c).to_pylist() for c in ("node", "label", "body"))):
            if key != now:
                hits += connecting_links(*held)
                now, held = key, ([], [], [])
            for column, v in zip(held, row):
                column.append(v)
        if hits:
            yield _links(hits)
    yield _links(connecting_links(*held))


def _links(hits: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in hits], pa.int64()),
                                       pa.array([y for _, y in hits], pa.int64())], names=["a", "b"])


def connecting_links(nodes: list[int], labels: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
    """Links between nodes of different labels, as many as it takes to join
    all labels that links join: every pair is compared on full sets unless its
    labels are joined already."""
    if len(set(labels)) < 2:
        return []
    sets = [s for part in _byte_parts(bodies) for s in shingle_sets(bodies[part])]
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    here = np.zeros(int(code.max()) + 1, dtype=np.int32)
    root = np.unique(labels, return_inverse=True)[1]
    out = []
    for x in range(len(nodes)):
        if (root == root[x]).all():
            break
        mine = code[starts[x]:starts[x] + size[x]]
        here[mine] = 1
        common = np.add.reduceat(here[code], starts)
        here[mine] = 0
        ok = (100 * common >= LINK_PERCENT * (size + size[x] - common)) & (root != root[x])
        for y in np.flatnonzero(ok).tolist():
            if root[y] != root[x]:
                out.append((nodes[x], nodes[y]))
                root[root == root[y]] = root[x]
    return out


def linked_within(family: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) that join the labels of each family (node, label, family).

    A family is cut into blocks of about ``BLOCK_NODES``: a label with more
    nodes has blocks of its own, smaller labels share blocks.  A task compares
    the nodes of two blocks, and blocks of one label are not compared, so a
    large component costs its size times the blocks of nodes outside it."""
    sizes = family.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    small = F.sum(F.when(F.col("c") <= BLOCK_NODES, F.col("c")).otherwise(0))
    sizes = sizes.join(sizes.groupBy("family").agg(small.alias("small")), "family")
    big = F.col("c") > BLOCK_NODES
    count = F.ceil(F.when(big, F.col("c")).otherwise(F.col("small")) / BLOCK_NODES)
    rows = (family.join(sizes, ["family", "label"])
            .select("family", "node", "label", F.when(big, F.col("label")).otherwise(F.lit(-1)).alias("l"),
                    F.pmod(F.xxhash64(F.when(big, F.col("node")).otherwise(F.col("label"))), count).alias("i")))
    blocks = rows.select("family", "l", "i").distinct()
    one, two = (blocks.withColumnsRenamed({"l": f"{s}l", "i": f"{s}i"}) for s in "ab")
    pairs = one.join(two, "family").filter("(al < bl or (al = bl and al = -1 and ai <= bi))")
    sides = pairs.select("*", F.explode(F.when((F.col("al") == F.col("bl")) & (F.col("ai") == F.col("bi")), F.array(
        F.struct(F.col("al").alias("l"), F.col("ai").alias("i")))).otherwise(F.array(
            F.struct(F.col("al").alias("l"), F.col("ai").alias("i")),
            F.struct(F.col("bl").alias("l"), F.col("bi").alias("i"))))).alias("s")).select("family", "al", "ai", "bl", "bi", "s.l", "s.i")
    key = ["family", "al", "ai", "bl", "bi"]
    return (rows.join(sides, ["family", "l", "i"]).select(*key, "node", "label").join(unsized(bodies), "node")
            .repartition(*key).sortWithinPartitions(*key).mapInArrow(_link_block, "a bigint, b bigint"))


def _odd_bits(x: str, y: str):
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_shingles, component_id (smallest
    doc_id reachable over links), kept (doc_id = component_id) and ``keeper``
    (true for exactly one row of each component)."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    sig = scratch.write(signatures(docs).withColumn("uid", F.monotonically_increasing_id()), "signatures")

    full = sig.filter("set_key is not null")
    classes = scratch.write(
        full.groupBy("set_key").agg(F.min("uid").alias("node"),
                                    F.min(F.struct("doc_id", "text_key")).alias("rep"),
                                    F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first_row"),
                                    F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    # members of band keys that more than one class has; Spark sizes the 32 rows of
    # a class as one
    banded = classes.select("node", F.explode("bands").alias("band"))
    centres = (banded.groupBy("band")
               .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", "band").alias("o"), "node")).alias("c"))
               .filter("n > 1").select("band", F.col("c.node").alias("centre")))
    shared = scratch.write(banded.join(unsized(centres), "band"), "shared")

    bodies = scratch.write(
        shared.select("node").distinct().join(classes.select("node", "rep"), "node")
        .select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"))
        .join(_keyed(docs).withColumnsRenamed({"doc_id": "d", "text_key": "t"}),
              F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
        .select("node", "body").dropDuplicates(["node"]), "bodies")

    sketches = classes.select("node", "sketch")
    near = F.expr(f"odd <= {most_odd_bits()}")

    # each band key links its members to one of them
    pairs = shared.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = (pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a")
             .join(sketches.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
             .select("a", "b", _odd_bits("sa", "sb").alias("odd")).filter(near))
    pairs = scratch.write(pairs, "pairs")
    best = pairs.groupBy("a").agg(F.min(F.struct("odd", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = scratch.write(confirmed(best, bodies), "links-1")
    label = scratch.write(components(links, scratch, "cc-1"), "label-1")

    # other pairs with a key's centre, where they would join components
    rest = _across(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), label)
    links = scratch.write(confirmed(rest, bodies), "links-2")
    label = _joined(label, links, scratch, "2")

    # all other pairs of a key's members that lie in different components
    member = shared.join(label, "node", "left").select("band", "node", "centre", F.coalesce("label", "node").alias("label"))
    mixed = member.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    member = scratch.write(member.join(mixed.select("band"), "band", "left_semi"), "mixed")
    near = components(_across(member.select(F.col("node").alias("a"), F.col("centre").alias("b")), label, named=True),
                      scratch, "near").select(F.col("node").alias("label"), F.col("label").alias("family"))
    family = scratch.write(member.select("node", "label").distinct().join(near, "label"), "family")
    links = scratch.write(linked_within(family, bodies), "links-3")
    label = _joined(label, links, scratch, "3")
    scratch.drop("bodies", "shared")

    classes = (classes.select("set_key", "first_row", F.col("node").alias("n"))
               .join(label, F.col("n") == F.col("node"), "left")
               .select("set_key", "first_row", F.coalesce("label", "n").alias("label")))
    first = classes.groupBy("label").agg(F.min("first_row").alias("f"))
    classes = classes.join(first, "label").select("set_key", F.col("f.doc_id").alias("c_id"), F.col("f.uid").alias("c_uid"))
    return (sig.select("doc_id", "text_key", "n_shingles", "set_key", "uid").join(classes, "set_key", "left")
            .withColumn("component_id", F.when(F.col("c_uid").isNull(), F.col("doc_id")).otherwise(F.col("c_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                    (F.coalesce("c_uid", "uid") == F.col("uid")).alias("keeper"), "text_key"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: the one of the smallest
    doc_id.  Rows equal in doc_id and text count as one."""
    keep = (near_duplicates(docs).filter("keeper").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"))
            .distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    rows = rows.select("d", F.col("d.doc_id").cast("bigint").alias("id"),
                       F.unhex(F.md5(F.coalesce("d.text", F.lit("")))).alias("key"))
    rows = rows.join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_text")), "left_semi")
    return rows.dropDuplicates(["id", "key"]).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def _joined(label: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels after more links: components of the labels that they connect."""
    ends = _across(links, label, named=True)
    merged = scratch.write(components(ends, scratch, f"cc-{name}"), f"merged-{name}")
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    moved = label.join(to, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return scratch.write(moved.unionByName(merged.join(label.select("node"), "node", "left_anti")), f"label-{name}")


def _across(pairs: DataFrame, label: DataFrame, named: bool = False) -> DataFrame:
    """Pairs whose ends lie in different components, by their ends or
    (``named``) by the labels of their ends."""
    la = label.withColumnsRenamed({"node": "a", "label": "la"})
    lb = label.withColumnsRenamed({"node": "b", "label": "lb"})
    out = (pairs.join(la, "a", "left").join(lb, "b", "left")
           .select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).filter("la <> lb"))
    return out.select(F.col("la").alias("a"), F.col("lb").alias("b")) if named else out.select("a", "b")
