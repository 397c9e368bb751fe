"""Token cache and packing against the tokenizer library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from kappaflow.llm import bpe, packing, token_cache
from kappaflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("digest", T.StringType()), T.StructField("length", T.LongType())])
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\tb c", "it's we'll 's x", "a \n b", "x\n\ny z", "é́ ü", "日本 語",
       "<|endoftext|>", "a <|endoftext|> b", "a<|startoftext|>b <|endoftext|>", "tab\t\tx", " x y　 z",
       "\x1c! \x1f?", "1234 5,6", "end \r\n", "ΣΑΣ σας", "!!!  ???", "a​ b", " ́x"]


def _random_texts(n=300, seed=3):
    rnd = random.Random(seed)
    alphabet = ["a", "b", "'s", "'ll", "é", "́", " ", " ", "\n", "\t", "1", "22", "!", "<|endoftext|>", "日", "\xa0", "\r"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_memo_equals_library():
    texts = ODD + _random_texts()
    tok = bpe.load(BYTE)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(packing.encode_texts(texts, BYTE)) == want
    tok = bpe.load(WORD)
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_cache.count_texts(texts, token_cache._memo(WORD)) == want


def test_memo_is_bounded():
    memo = bpe.ChunkMemo(lambda c: [len(x) for x in c], limit=10)
    for i in range(100):
        got = memo.values({f"w{i}", f"v{i}"})
        assert got[f"w{i}"] == len(f"w{i}")
    assert len(memo.young) + len(memo.old) <= 26


def test_count_tokens_edges(spark, tmp_path):
    long = "word " * 50_000
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, None, None), (3, "", "y", 2), (None, " a b\n", "z", 3), (4, long, "", 0)]
    docs = spark.createDataFrame(rows, DOC)
    tok = bpe.load(WORD)
    got = sorted(map(tuple, token_cache.count_tokens(docs, WORD, str(tmp_path)).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids))
                   for d, t, _, _ in rows), key=str)
    assert got == want
    assert token_cache.count_tokens(docs.limit(0), WORD, str(tmp_path)).count() == 0


def test_cache_encodes_only_misses(spark, tmp_path):
    first = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    store = token_cache.fill_cache(first, WORD, str(tmp_path))
    assert spark.read.parquet(store).count() == 2
    more = spark.createDataFrame([(3, "three"), (4, "four"), (5, "four")], "doc_id long, text string")
    token_cache.fill_cache(more, WORD, str(tmp_path))
    assert spark.read.parquet(store).count() == 3
    assert token_cache.tokenizer_version(WORD) != token_cache.tokenizer_version(BYTE)


def _check_packing(rows, texts, capacity):
    tok = bpe.load(BYTE)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        parts.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // capacity)))
        at = 0
        for k, p in enumerate(parts):
            assert p["start"] == at and (k == 0 or p["length"] == capacity)
            part = np.array(ids[at:at + p["length"]], dtype="<u4").tobytes()
            assert (p["ids"] == part) if "ids" in p.asDict() else (p["ids_crc32"] == zlib.crc32(part))
            at += p["length"]
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("capacity", [16, 512])
def test_pack_round_trip(spark, capacity):
    rnd = random.Random(1)
    texts = {i: "word " * rnd.randint(0, 60) for i in range(200)}
    texts[500] = None
    texts[501] = "x y " * 5000
    docs = spark.createDataFrame([(k, v, "c", 7) for k, v in texts.items()], DOC)
    rows = packing.pack(docs, BYTE, capacity).collect()
    n = _check_packing(rows, texts, capacity)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // capacity) * 1.15 + 1


def test_pack_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], DOC), BYTE).count() == 0
    docs = spark.createDataFrame([(1, "a b", None, None)] * 5 + [(None, "c", None, None)], DOC)
    rows = packing.pack(docs, BYTE, 4).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


def test_plan_holds_every_piece_once():
    rnd = np.random.default_rng(5)
    for n in (1, 10, 500, 20_000):
        lengths = np.minimum(2048, rnd.lognormal(6, 1.2, n).astype(int) + 1)
        hist = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        packed = packing.plan(hist, 2048, steps=60)
        held = {}
        for conf, k in packed:
            assert sum(a * b for a, b in conf.items()) <= 2048
            for a, b in conf.items():
                held[a] = held.get(a, 0) + b * k
        assert held == hist
        assert sum(k for _, k in packed) <= max(1, -(-int(lengths.sum()) // 2048)) * 1.03 + 2


def test_queries(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _check_packing(QUERIES["op9_packing"](spark, SF).collect(), docs, 2048)
    tok = bpe.load(WORD)
    for r in QUERIES["op7_token_cache"](spark, SF).collect():
        n = len(tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)


def test_pipeline_and_query_pack_the_ids(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert "ids" in rows[0].asDict()
    _check_packing(rows, texts, 2048)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        sequences.setdefault(r["sequence_id"], []).extend(np.frombuffer(r["ids"], dtype="<u4").tolist())
    tok = bpe.load(BYTE)
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    assert sum(map(len, sequences.values())) == want and max(map(len, sequences.values())) <= 2048

    packed, real = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: packed.append(real(*a, **k)) or packed[0])
    digests = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in QUERIES["op9_packing"](spark, SF).collect()}
    assert digests == {(r["doc_id"], r["piece"]): zlib.crc32(r["ids"]) for r in packed[0].collect()}


def test_configuration_program_places_most_pieces():
    rng = np.random.default_rng(5)
    for n in (3_000, 60_000):
        drawn = np.minimum(rng.lognormal(6.2, 0.9, n).astype(int) + 1, 2048)
        lengths, counts = np.unique(drawn, return_counts=True)
        packed = packing.plan(dict(zip(lengths.tolist(), counts.tolist())), 2048)
        held = {}
        for conf, copies in packed:
            assert sum(k * v for k, v in conf.items()) <= 2048
            for k, v in conf.items():
                held[k] = held.get(k, 0) + v * copies
        assert held == dict(zip(lengths.tolist(), counts.tolist()))
        plain = sum(c for _, c in packing.best_fit(lengths, counts, 2048))
        assert sum(c for _, c in packed) <= plain + 1
        small = lengths < 2048
        program = packing.configuration_program(lengths[small], counts[small], 2048)
        placed = sum(v * copies for conf, copies in program for v in conf.values())
        assert placed >= 0.9 * counts[small].sum()


def test_nearest_vectors(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)], "c") for i in range(300)]
    rows += [(300, rows[0][1], "copy"), (301, None, ""), (302, [0.0] * 8, ""), (303, [float("nan")] * 8, ""),
             (304, [1.0], ""), (305, [None] * 8, ""), (306, [1e200] * 8, ""), (None, [1.0] * 8, "")]
    from kappaflow.llm import dimension_scan

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    got = {}
    for r in dimension_scan.nearest(df, "vec_id % 20 = 0", k=5, dim=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([r[0] for r in rows if r[0] is not None and r[0] not in (301, 302, 303, 304, 305)])
    v = np.array([r[1] for r in rows if r[0] in set(ids.tolist())])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    assert set(got) == set(queries)
    for q in queries:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        hits += len(want & {x for _, x, _ in found})
    assert hits >= 0.9 * 5 * len(queries)
    assert dimension_scan.nearest(df.limit(0), "vec_id % 20 = 0", dim=8).count() == 0


def test_scan_reads_less_than_half_and_finds_neighbours(spark):
    from kappaflow.llm import dimension_scan as scan

    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    ids = np.arange(len(x))
    turned = scan._unit(x) @ scan.rotation(64)
    q = ids[::200]
    cos = scan._unit(x[q]) @ scan._unit(x).T
    cos[np.arange(len(q)), q] = -9
    want = np.argsort(-cos, axis=1)[:, :5]
    bound = 2 - 2 * np.take_along_axis(cos, want[:, 4:], axis=1)[:, 0]
    hits = read = visited = 0
    for lo in range(0, len(x), 4_000):
        part = slice(lo, lo + 4_000)
        rows, found, score, n = scan.scan_block(x[q], turned[q], q, bound, ids[part], x[part], turned[part], 5)
        hits += sum(f in set(want[r].tolist()) for r, f in zip(rows.tolist(), found.tolist()))
        read += n
        visited += len(q) * 4_000 * 64
        np.testing.assert_allclose(score, cos[rows, found], rtol=1e-9)
    assert hits >= 0.95 * want.size
    assert read < 0.5 * visited


def test_nearest_with_repeated_ids(spark):
    from kappaflow.llm import dimension_scan

    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (5, [1.0, 1.0]), (5, [2.0, 2.0]), (7, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in dimension_scan.nearest(df, "vec_id = 0 or vec_id = 20", k=3, dim=2, probe_share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[0]) == [(1, 5), (2, 5), (3, 20)]
    assert [v for _, v in sorted(got[20])] == [5, 5, 5]


def test_tasks_leave_no_memo_behind():
    import pyarrow as pa
    import public_tokenizers

    from kappaflow.llm import importance, packing
    from kappaflow.llm.common import forgetting

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words here"]})
    task = forgetting(packing._cutter(path, 2048), packing._forget)
    assert sum(b.num_rows for b in task([rows])) == 1
    enc = packing.encoder(path)
    assert not (enc.first.young or enc.first.old or enc.later.young or enc.later.old)
    assert list(forgetting(importance._counter, importance._forget)([rows.select(["text"])])) and not importance._MEMO
