"""The conversation trie against a trie built by insertion."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kappaflow.llm import prefix_trie
from kappaflow.llm.common import Scratch
from kappaflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos long, digest string, part int, j string"


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out[c].append(((turn is not None, turn or 0, tie), (role, text)))
    return {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def rebuilt(convs, every=100, most=6):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    if not convs:
        return Counter()
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    stats = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        stats[p] = (sum(stats[k][0] for k in children[p]) or 1, saved + sum(stats[k][1] for k in children[p]))
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *stats[p],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def rows_of(seed, n, longest=9, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            rows.append((c * 3 - 40, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "bb", "é€", ""][:words])))
    hot = [(t, "user", f"hot {t}") for t in range(7)]
    for c in range(5_000, 5_060):
        rows += [(c, *t) for t in hot]
    for c in range(6_000, 6_030):
        rows += [(c, *t) for t in hot[:3]]
    rows += [(7_000, None, None, None), (7_000, 3, "x", "y"), (7_000, 3, "x", "z"), (7_000, 3, "x", "z"), (7_000, None, "r", None),
             (None, 1, "user", "nobody"), (7_001, 0, "user", "long " * 30_000), (7_002, 1, "u:x", "y"), (7_003, 1, "u", ":xy")]
    long = [(t, "user", f"t{t % 5}") for t in range(150)]
    rows += [(8_000, *t) for t in long] + [(8_001, *t) for t in long] + [(8_002, *t) for t in long[:64]]
    rows += [(8_003, *t) for t in long[:128]] + [(8_004, *t) for t in long[:100]] + [(8_004, 200, "bot", "else")]
    rows += [(8_005, *t) for t in long[:64]] + [(8_005, 64, "bot", "other")] + [(8_006, *t) for t in long[:128]] + [(8_007, *t) for t in long[:64]]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "j") for r in rows], SCHEMA)


@pytest.mark.parametrize("chunk,part_rows,piece", [(64, 50_000, 8_192), (4, 7, 3), (1, 11, 8_192)])
def test_trie_equals_insertion(spark, monkeypatch, chunk, part_rows, piece):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PART_ROWS", part_rows)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    rows = rows_of(chunk, 90)
    got = Counter(map(tuple, prefix_trie.conversation_trie(frame(spark, rows)).collect()))
    assert got == brute(ordered(rows))


@pytest.mark.parametrize("part_rows", [50_000, 9])
def test_shared_openings(spark, monkeypatch, part_rows):
    monkeypatch.setattr(prefix_trie, "PART_ROWS", part_rows)
    rows = [r for r in rows_of(5, 150) if r[0] is None or r[0] % 100 or r[0] % 300]
    scratch = Scratch(spark, "t")
    nodes = prefix_trie.trie(*prefix_trie.with_openings(prefix_trie.numbered_turns(frame(spark, rows), scratch), scratch), scratch)
    convs = rebuilt(ordered(rows))
    assert any(not t for t in convs.values())
    assert Counter(map(tuple, nodes.collect())) == brute(convs)


def test_no_turns(spark):
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0
    only = prefix_trie.conversation_trie(frame(spark, [(None, 1, "a", "b")]))
    assert only.count() == 0


def test_extents_equal_scan():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 200):
        lcp = rng.integers(0, 5, n + 1)
        table = prefix_trie.sparse_table(lcp[1:n]) if n > 1 else []
        row, depth = rng.integers(0, n, 300), rng.integers(1, 5, 300)
        lo, hi = prefix_trie.left_extent(table, row, depth), prefix_trie.right_extent(table, row, depth)
        for i, d, a, b in zip(row, depth, lo, hi):
            x = y = i
            while x > 0 and lcp[x] >= d:
                x -= 1
            while y < n - 1 and lcp[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)
            v = rng.integers(0, 99, n)
            assert prefix_trie.range_min(prefix_trie.sparse_table(v), np.array([x]), np.array([y]))[0] == v[x:y + 1].min()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_prefix_trie"](spark, sf)
    assert Counter(map(tuple, got.collect())) == brute(rebuilt(ordered(rows)))
