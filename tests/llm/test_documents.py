"""Line dedup, near duplicates, decontamination, quality, toxicity, formats:
edge cases and brute force on small tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaflow.llm import (components, decontamination, importance, line_dedup, odd_minhash, perspectives,
                           toxicity_crf, url_filters)
from kappaflow.llm.common import Scratch
from kappaflow.llm.queries import QUERIES

DOC = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("code", T.StringType()), ("n", T.LongType()),
    ("label", T.StringType()), ("node", T.LongType()), ("doc", T.StringType()), ("tk", T.StringType()))])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, "l", 2, "d", "k") for i, t in rows], DOC)


def words(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randint(0, vocab)}" for _ in range(n))


def corpus(seed=4, groups=12):
    """Unrelated texts, copies, near copies, shared lines, odd texts."""
    rnd = random.Random(seed)
    rows, k = [], 0
    for _ in range(40):
        rows.append((k := k + 1, "\n".join(words(rnd, rnd.randint(1, 30)) for _ in range(rnd.randint(1, 4)))))
    for _ in range(groups):
        base = words(rnd, rnd.randint(6, 60)).split()
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9)}"
            rows.append((k := k + 1, " ".join(w)))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \n\t "), (k + 4, "One"), (k + 5, "one"), (None, rows[3][1]),
             (k + 6, rows[3][1]), (k + 6, rows[3][1]), (k + 7, "a b c d e\r\nf\tg"), (k + 8, words(rnd, 30_000, 5_000))]
    rnd.shuffle(rows)
    return rows


# ---- line dedup ---------------------------------------------------------------

def brute_lines(rows, t):
    """Removed line numbers of each (doc_id, text)."""
    lines = []
    for d, text in set(rows):
        for i, line in enumerate((text or "").split("\n")):
            s = frozenset(line.replace("\r", " ").split())
            if s:
                lines.append((float("inf") if d is None else d, d, text, i, s))
    gone = defaultdict(set)
    for a, b in combinations(lines, 2):
        inter = len(a[4] & b[4])
        if inter >= t * len(a[4] | b[4]) - 1e-9 and (a[0], a[3]) != (b[0], b[3]):
            later = max(a, b, key=lambda x: (x[0], x[3]))
            gone[later[1], later[2]].add(later[3])
    return gone


def test_line_dedup(spark):
    rows = corpus()
    rnd = random.Random(9)
    base = words(rnd, 30).split()
    for k in range(60):  # many near copies of one line
        rows.append((1000 + k, "head\n" + " ".join(base[:26] + [f"y{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 5))])))
    want = brute_lines(rows, line_dedup.THRESHOLD)
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*DOC.names, "n_removed"}
    by_key = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got)
    expect = Counter()
    for d, text in rows:
        out = sorted(want.get((d, text), ()))
        cut = text if not out else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
        expect[d, cut, len(out)] += 1
    # lines inside are compared with odd white space read as spaces, text is kept as it is
    assert by_key == expect
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    # words that many lines share go another way to the same result
    short = line_dedup.removed_lines(docs(spark, rows), short=2).collect()
    assert sum(len(r["removed"]) for r in short) == sum(len(v) for v in want.values())
    clash = line_dedup.dedup_lines(docs(spark, rows).withColumn("n_removed", F.lit("x")))
    assert clash.columns == [*DOC.names, "n_removed"] and clash.filter("n_removed > 0").count() > 0


def test_long_lines_that_share_words_make_no_pairs(spark, monkeypatch):
    """64 parity bits cannot tell apart long sets that have a third in common."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(600)]
    rows = [(k, " ".join(rng.sample(vocabulary, 200))) for k in range(40)]
    rows.append((40, rows[7][1].replace("w1", "w9", 1)))
    pairs, write = [], Scratch.write

    def spy(self, df, name):
        out = write(self, df, name)
        pairs.extend([out.count()] if name == "pairs" else [])
        return out
    monkeypatch.setattr(Scratch, "write", spy)
    got = {r["doc"]: list(r["removed"]) for r in line_dedup.removed_lines(docs(spark, rows)).collect()}
    assert got == {d: sorted(v) for (d, _), v in brute_lines(rows, line_dedup.THRESHOLD).items() if v} == {40: [0]}
    assert pairs[0] < 20  # of 820; 64 bits leave 315



# ---- near duplicates ------------------------------------------------------------

def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) >= 5:
        return frozenset(b" ".join(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([b" ".join(w)]) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(spark):
    rows = corpus(7, groups=30)
    rnd = random.Random(2)
    base = words(rnd, 80).split()
    for k in range(80):  # a chain-like group: copies of copies
        base[rnd.randrange(80)] = f"z{k}"
        rows.append((2000 + k, " ".join(base)))
    got = odd_minhash.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    one = odd_minhash.one_of_each(docs(spark, rows)).collect()
    full = [r for r in one if shingles(r["text"])]
    assert len(full) == len({c for d, n, c in brute_components(rows) if n})
    assert odd_minhash.near_duplicates(docs(spark, [])).count() == 0


def broadcast_explodes(plan):
    """Explodes inside the broadcasts of a plan's text."""
    depth, out = None, []
    for line in plan.split("\n"):
        at = re.search(r"[A-Za-z(*]", line)
        at = at.start() if at else 0
        depth = None if depth is not None and at <= depth else depth
        if depth is not None and "Generate" in line:
            out.append(line.strip())
        if depth is None and "BroadcastExchange" in line:
            depth = at
    return out


@pytest.mark.parametrize("run, names", [
    (odd_minhash.near_duplicates, ["shared"]), (line_dedup.removed_lines, ["pairs", "gone-1"])], ids=["near_dups", "lines"])
def test_exploded_rows_are_never_broadcast(spark, tmp_path, monkeypatch, run, names):
    """Spark sizes an exploded table like the one before, so it would send large
    ones through the driver."""
    docs(spark, corpus()[:60]).write.parquet(str(tmp_path / "documents"))
    plans, write = {}, Scratch.write

    class Seen(Exception):
        pass

    def spy(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        if name == names[-1]:
            raise Seen
        return write(self, df, name)
    monkeypatch.setattr(Scratch, "write", spy)
    with pytest.raises(Seen):
        run(spark.read.parquet(str(tmp_path / "documents")))
    for name in names:
        assert "Generate" in plans[name] and "Join" in plans[name] and not broadcast_explodes(plans[name]), name


def test_sketch_estimate():
    rnd = np.random.default_rng(0)
    for j in (0.75, 0.9, 1.0):
        low = 0
        for _ in range(200):
            n = 400
            both = int(round(2 * n * j / (1 + j)))
            x = rnd.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            s = odd_minhash.min_hashes([x[:n], x[n - both:]])
            k = odd_minhash.odd_sketches(s)
            odd = sum(int(a ^ b).bit_count() for a, b in zip(k[0].tolist(), k[1].tolist()))
            low += odd > odd_minhash.most_odd_bits()
        assert low == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(df, Scratch(spark, "t"), "c").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


# ---- decontamination --------------------------------------------------------------

def test_decontamination(spark):
    rnd = random.Random(5)
    items = [(i, words(rnd, rnd.randint(8, 60), 3000)) for i in range(25)] + [(90, None), (91, ""), (92, "Two words"), (None, "x y z u v w q")]
    rows = corpus(3)
    for k in range(40):
        q = items[rnd.randrange(25)][1].split()
        for _ in range(rnd.randint(0, 4)):
            q[rnd.randrange(len(q))] = "other"
        rows.append((3000 + k, words(rnd, 200, 3000) + "\n" + " ".join(q).upper() + "\t" + words(rnd, 50, 3000)))
    rows += [(4000, "two  WORDS"), (4001, "two words more"), (4002, "x y z u v w q")]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontamination.contained(docs(spark, rows), it).collect())
    low = lambda t: shingles((t or "").lower())
    want = Counter()
    for d, t in set(rows):
        for i, q in items:
            s = low(q)
            short = 0 < len((q or "").split()) < 5
            k = int(runs(q, len(q.split())) <= runs(t, len(q.split()))) if short else len(s & low(t))
            if s and k >= len(s) - int(0.25 * len(s) + 1e-9):
                want[d, i, k, len(s)] += 1
    assert got == want and sum(want.values()) > 10
    clean = decontamination.clean_documents(docs(spark, rows), it)
    assert clean.columns == DOC.names
    hit = {d for d, *_ in want}
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((d for d, _ in rows if d not in hit), key=str)
    assert decontamination.contained(docs(spark, []), it).count() == 0
    assert decontamination.clean_documents(docs(spark, rows), it.limit(0)).count() == len(rows)


def runs(text, m):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + m]) for i in range(len(w) - m + 1)}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_short_items_inside_long_documents(spark, broadcast):
    rnd = random.Random(9)
    short = [(1, "Zeta"), (2, "two words"), (3, "three of them"), (4, "four five six  seven"), (5, "zeta\tzeta"), (6, "absent item")]
    long = [(10, words(rnd, 30))]
    rows = [(i, words(rnd, 60)) for i in range(30)]
    for i, (_, q) in enumerate(short[:5] + long):
        rows += [(100 + i, words(rnd, 300) + "\n" + q.upper() + " " + words(rnd, 300)), (200 + i, q), (300 + i, q + " end"),
                 (400 + i, "start " + q), (500 + i, q.replace(" ", " x "))]
    rows += [(600, "one two words four five six seven zeta end"), (601, None), (602, ""), (None, "a two words b c d"),
             (200, "Zeta"), (200, "Zeta"), (603, "two words two words two words"), (604, "zetas two  wordsx")]
    it = spark.createDataFrame(short + long + [(20, None), (21, " ")], "item_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"])
                      for r in decontamination.contained(docs(spark, rows), it).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = Counter()
    for d, t in set(rows):
        for i, q in short:
            m = len(q.split())
            if runs(q, m) <= runs(t, m):
                want[d, i, 1, 1] += 1
        for i, q in long:
            k = len(runs(q, 5) & runs(t, 5))
            if k >= 26 - int(0.25 * 26):
                want[d, i, k, 26] += 1
    assert got == want and {i for _, i, *_ in want} == {1, 2, 3, 4, 5, 10}


# ---- quality ----------------------------------------------------------------------

def test_codes_of_a_line_are_plain_longs(spark):
    rows = spark.createDataFrame([(1, 2, 0, "a b c d e")], "doc long, tk long, line_no int, line string")
    assert not line_dedup._sets(rows, [0] * 8, 0.8).schema["prefix"].dataType.containsNull  # nulls are sorted as objects


def shuffled_rows(spark, df, folder):
    """Rows that the tasks of ``df`` hand to shuffles, by the plan's metrics."""
    df.write.parquet(str(folder))
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    df.collect()
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            plans.append(p.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_keep_good_moves_only_rows_that_may_go(spark, tmp_path, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, words(rnd, 20)) for i in range(600)] + [(700 + i, "JUNK!! 99") for i in range(20)] + [(None, "x"), (5, None), (5, None)]
    d = docs(spark, rows)
    good = spark.createDataFrame([(i,) for i in range(600)], "doc_id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = importance.keep_good(d, good, 600)
        assert shuffled_rows(spark, kept, tmp_path / "kept") < 200  # the rows dropped, their keys and marks
        wanted = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        monkeypatch.setattr(importance, "MARKS", 64)  # nearly every row shares a mark with a dropped one
        again = importance.keep_good(d, good, 600)
        assert sorted(((r["doc_id"], r["text"]) for r in again.collect()), key=str) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    drop = {(r["doc_id"], r["tk"]) for r in importance.resample(d, good, 600).filter("not kept").collect()}
    tk = {(r["doc_id"], r["text"]): r["tk"] for r in d.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as tk").collect()}
    assert drop and wanted == sorted(((i, t) for i, t in rows if (i, tk[i, t]) not in drop), key=str)


def test_marks_hold_exactly_the_cells_given(spark):
    cells = [0, 7, 8, 255, 32767, 32768, 40001, (1 << 26) - 1]
    rows = spark.createDataFrame([(c,) for c in sorted({max(0, c + k) for c in cells for k in (-1, 0, 1)})], "cell long")
    marks = importance._marks(spark.createDataFrame([(c,) for c in cells + cells], "cell long"))
    assert [r["cell"] for r in importance._marked(rows, marks).filter("marked").orderBy("cell").collect()] == cells


def test_importance(spark):
    rnd = random.Random(6)
    rows = [(i, words(rnd, rnd.randint(3, 80), 20) if i % 5 else " ".join(f"JUNK{rnd.randint(0, 99)}!!" for _ in range(30))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "w1 w2"), (503, "w1 w2 w3"), (503, "w1 w2 w3")]
    d = docs(spark, rows)
    good = spark.createDataFrame([(i,) for i in range(200) if i % 5], "doc_id long")
    got = importance.resample(d, good).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["kept"] == bool(r["doc_id"] % 5)
        else:
            assert r["kept"]
    for k in (0, 1, 37, 405, 10_000):
        part = importance.resample(d, good, k).collect()
        keys = sorted((r["gumbel_key"] for r in part), reverse=True)
        least = keys[k - 1] if 0 < k <= len(keys) else (float("inf") if k == 0 else -float("inf"))
        assert all(r["kept"] == (r["gumbel_key"] >= least) for r in part)
    kept = importance.keep_good(d, good)
    assert kept.columns == DOC.names and kept.count() == sum(r["kept"] for r in got)
    long = importance.resample(docs(spark, [*rows, (900, words(rnd, 30_000))]), good).filter("doc_id = 900").collect()
    assert len(long) == 1 and np.isfinite(long[0]["log_weight"])
    assert importance.resample(docs(spark, []), good).count() == 0
    assert all(r["kept"] for r in importance.resample(d, good.limit(0)).collect())


def test_target_counts_all_good_documents(spark):
    rnd = random.Random(8)
    rows = [(i, words(rnd, 40, 30 + i % 7)) for i in range(120)] + [(None, "w1 w2"), (3, "w5 w6")]
    d, good = docs(spark, rows), spark.createDataFrame([(i,) for i in range(0, 120, 3)] + [(0,), (None,)], "doc_id long")
    ids = set(range(0, 120, 3))
    f, of = importance._features([t for _, t in rows])
    is_good = np.array([i in ids for i, _ in rows])
    n = [np.bincount(x, minlength=importance.FEATURES) + importance.SMOOTHING for x in (f[is_good[of]], f)]
    cut = importance.BUCKETS
    parts = [[np.log(m[k] / m[k].sum()) for m in n] for k in (slice(0, cut), slice(cut, None))]
    want = np.concatenate([t - r for t, r in parts])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in ("10m", "-1"):  # the join that Spark picks does not matter
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            assert np.allclose(importance.fit(d, good), want)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_weights_equal_brute_force():
    texts = ["Alpha beta! beta beta 12", "", "x"]
    f, d = importance._features(texts)
    ratio = np.random.default_rng(0).normal(size=importance.FEATURES)
    w = np.bincount(d, weights=ratio[f], minlength=3)
    alone = [ratio[importance._features([t])[0]].sum() for t in texts]
    assert np.allclose(w, alone) and len(f) == 6 + 5 + 5 + 1


# ---- toxicity ---------------------------------------------------------------------

def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 130, 64, 65, 7])
    odds, trans = rng.normal(size=lengths.sum()) * 3, rng.normal(size=(2, 2))
    p, pairs = toxicity_crf.marginals(odds, lengths, trans)
    t, at, total = np.exp(trans), 0, np.zeros((2, 2))
    for n in lengths:
        o = odds[at:at + n]
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        for i in range(n):
            a[i] = (a[i - 1] @ t if i else np.ones(2)) * [1, np.exp(o[i])]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = t @ (np.array([1, np.exp(o[i + 1])]) * b[i + 1])
            b[i] /= b[i].sum()
        m = a * b
        if n:
            assert np.allclose((m / m.sum(axis=1, keepdims=True))[:, 1], p[at:at + n])
        for i in range(1, n):
            q = a[i - 1][:, None] * t * (np.array([1, np.exp(o[i])]) * b[i])[None]
            total += q / q.sum()
        at += n
    assert np.allclose(total, pairs)


def test_toxicity(spark):
    rnd = random.Random(8)
    bad = ["foul", "nasty", "vilest"]
    rows, labels = [], []
    for i in range(600):
        w = words(rnd, rnd.randint(10, 60)).split()
        y = int(i % 3 == 0)
        if y:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad).title() + rnd.choice(["", "!", ","]))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    extra = [(700, None), (701, ""), (702, "w1 " * 30_000), (703, "so Nasty foul w2"), (703, "so Nasty foul w2"), (None, "foul foul w1")]
    lab = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (5, None)], "doc_id long, toxic int")
    d = docs(spark, rows + extra)
    model = toxicity_crf.fit(d, lab, 300)
    got = {}
    for r in toxicity_crf.score(d, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    held = [(i, y) for i, y in labels if i % 4 == 0]
    assert np.mean([(got[i][0]["score"] >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert got[700][0]["score"] == got[701][0]["score"] < 0.5 and got[702][0]["score"] < 0.5
    assert [(s["start"], s["end"]) for s in got[703][0]["spans"]] == [(3, 13)] and len(got[703]) == 2
    assert got[None][0]["score"] > 0.5
    assert toxicity_crf.score(docs(spark, []), model).count() == 0
    none = toxicity_crf.fit(d, lab.limit(0))
    assert none is None and {r["score"] for r in toxicity_crf.score(d, none).collect()} == {0.0}


# ---- formats and filters --------------------------------------------------------------

def test_perspectives(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, part long"
    rows = [(1, 0, "system", "be kind"), (1, 2, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, "cat", "late"),
            (2, 0, "system", "alone"), (None, 0, "dan", "x"), (3, 0, None, "who"), (4, 5, "ann", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], schema)
    got = defaultdict(list)
    for r in perspectives.rotate(df).collect():
        got[r["conv_id"], r["perspective"]].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cat"), (None, "dan"), (3, "unknown"), (4, "ann")}
    for segs in got.values():
        segs.sort(key=lambda r: r["seq"])
        whole = "".join(r["segment"] for r in segs)
        at = 0
        for k, r in enumerate(segs):
            assert (r["seq"], r["start"], r["end"]) == (k, at, at + len(r["segment"]))
            at = r["end"]
            if r["speaker"] == r["perspective"]:
                assert r["segment"].startswith("<|assistant|>\n")
                assert whole[r["mask_start"]:r["mask_end"]] == r["segment"][len("<|assistant|>\n"):]
            else:
                assert r["mask_start"] is None
    assert "".join(r["segment"] for r in got[1, "bob"]) == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n<|user:ann|>\nhi<|end|>\n<|user:cat|>\nlate<|end|>\n")
    assert perspectives.rotate(df.limit(0)).count() == 0


def test_perspectives_over_parts(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "PARTITION_ROWS", 7)
    df = spark.range(100).selectExpr("id % 2 as conv_id", "id as turn", "if(id % 3 = 0, 'a', 'b') as role", "repeat('x', cast(id % 5 as int)) as text")
    for p in ("a", "b"):
        segs = perspectives.rotate(df).filter(f"conv_id = 0 and perspective = '{p}'").orderBy("turn").collect()
        at = 0
        for k, r in enumerate(segs):
            assert (r["seq"], r["start"]) == (k, at)
            at += len(r["segment"])


def test_query_gives_urls_histories(spark):
    rows = QUERIES["op10_url_filters"](spark, "/root/testdata/sf0.001").collect()
    by_url = [r for r in rows if r["kind"] == "url"]
    assert len(by_url) > len(rows) / 4
    assert any(r["valid_to"] is not None for r in by_url) and any(r["valid_to"] is None for r in by_url)


def test_url_filters(spark):
    from datetime import date

    d = lambda m, x: date(2024, m, x)
    entries = [("host", "a.b.com", d(1, 5), "block"), ("host", "a.b.com", d(3, 1), "drop"), ("host", "a.b.com", d(6, 1), "allow"),
               ("domain", "b.com", d(2, 1), "block"), ("url", "a.b.com/x?q", d(2, 10), "allow"), ("url", "a.b.com/x?q", d(2, 10), "drop"),
               ("host", "a.b.com", d(1, 5), "allow"), (None, "b.com", d(1, 1), "block"), ("host", None, d(1, 1), "block"),
               ("host", "a.b.com", None, "block"), ("host", "a.b.com", d(1, 1), "nonsense")]
    caps = [(1, "http://A.b.com/y", d(1, 4)), (2, "http://a.b.com/y", d(1, 5)), (3, "http://a.b.com./y", d(2, 28)),
            (4, "https://u@a.b.com:8/x?q#f", d(2, 10)), (5, "http://a.b.com/z", d(4, 1)), (6, "http://a.b.com/z", d(7, 1)),
            (7, "http://c.b.com", d(1, 31)), (8, "http://c.b.com", d(2, 1)), (9, None, d(2, 1)), (10, "junk", d(2, 1)), (11, "http://c.b.com", None),
            (8, "http://c.b.com", d(2, 1)), (12, "http://" + "x" * 9000, d(2, 1)), (13, "http://b.com/", d(12, 31))]
    c = spark.createDataFrame([(*x, "m") for x in caps], "page_id long, url string, fetched date, month string")
    e = spark.createDataFrame(entries, "kind string, entity string, listed_on date, action string")
    out = url_filters.evaluate(c, e)
    assert out.columns[:4] == c.columns
    got = Counter((r["page_id"], r["decision"], r["kind"], r["valid_to"]) for r in out.collect())
    assert got == Counter([(1, "none", None, None), (2, "block", "host", d(3, 1)), (3, "block", "host", d(3, 1)), (4, "allow", "url", None),
                           (5, "block", "domain", None), (6, "allow", "host", None), (7, "none", None, None), (8, "block", "domain", None),
                           (8, "block", "domain", None), (9, "none", None, None), (10, "none", None, None), (11, "none", None, None),
                           (12, "none", None, None), (13, "block", "domain", None)])
    assert url_filters.evaluate(c.limit(0), e).count() == 0
    assert {r["decision"] for r in url_filters.evaluate(c, e.limit(0)).collect()} == {"none"}


@pytest.mark.parametrize("name", ["op5_importance", "op3_toxicity_crf", "op8_odd_minhash"])
def test_queries_without_twin(spark, name):
    from kappaflow.llm.queries import QUERIES

    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == n


def test_url_filters_with_clashing_names(spark):
    captures = spark.createDataFrame([("http://a.com/x", "2024-03-05", "mine", 1, "k"), (None, "2024-03-05", "m", 2, None)],
                                     "url string, fetched string, decision string, Kind int, valid_from_ string")
    entries = spark.createDataFrame([("host", "a.com", "block", "2024-01-01")],
                                    "kind string, entity string, action string, listed_on string")
    out = url_filters.evaluate(captures, entries)
    assert out.columns == ["url", "fetched", "decision", "Kind", "valid_from_", "decision_", "kind_", "valid_from", "valid_to"]
    got = {r["url"]: (r["decision"], r["Kind"], r["decision_"], r["kind_"]) for r in out.collect()}
    assert got == {"http://a.com/x": ("mine", 1, "block", "host"), None: ("m", 2, "none", None)}


def test_url_twin_keeps_captures_without_host(spark, tmp_path):
    import duckdb

    from kappaflow.llm.queries import ORACLE

    pages = spark.createDataFrame([(1, "http://a.b.com/x#y"), (2, "no url"), (3, None), (4, "http://A.b.com./x"), (5, "")],
                                  "page_id long, url string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(repr, map(tuple, QUERIES["op10_url_filters"](spark, str(tmp_path)).select(
        "page_id", "decision", "kind", "valid_from", "valid_to").collect())))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute("select page_id, decision, kind, cast(valid_from as date), cast(valid_to as date) from ("
                       + ORACLE["op10_url_filters"] + ")").fetchall()
    assert len(got) == 5 and got == sorted(map(repr, want))


def test_perspectives_order_ties_by_role_and_text(spark):
    said = ["delta", "eta", "alpha", "a", "a!", "gamma", "alpha"]
    df = spark.createDataFrame([(1, 1, "u", t) for t in said] + [(1, 1, "b", "zeta")],
                               "conv_id long, turn int, role string, text string")
    for p in ("u", "b"):
        rows = perspectives.rotate(df).filter(F.col("perspective") == p).orderBy("seq").collect()
        texts = [r["segment"].split("\n", 1)[1].removesuffix(perspectives.END) for r in rows]
        assert texts == ["zeta", *sorted(said)]
        assert [r["start"] for r in rows] == [0, *[r["end"] for r in rows[:-1]]]


def test_scratch_made_in_a_block_goes_with_it(spark):
    import os

    from kappaflow.llm.common import released_scratch

    kept = Scratch(spark, "kept")
    with released_scratch():
        inner = Scratch(spark, "inner")
        rows = kept.write(inner.write(spark.range(5).toDF("doc_id"), "a"), "b")
    at = lambda s: s.root.removeprefix("file:")
    assert rows.count() == 5 and os.path.exists(at(kept)) and not os.path.exists(at(inner))
