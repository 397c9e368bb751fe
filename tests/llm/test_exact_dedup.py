"""Exact dedup against brute force, with forced hash collisions."""

import hashlib
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from kappaflow.llm import exact_dedup
from kappaflow.llm.queries import QUERIES

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOC = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("h", T.StringType()), ("body", T.StringType()),
    ("kept", T.StringType()), ("keep_id", T.LongType()), ("k_id", T.LongType()), ("d", T.StringType()))])
ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "same text "), (5, None), (6, ""), (7, "É a"), (8, "é a"),
        (9, "É A"), (10, "İ x"), (11, "i̇ x"), (None, "same text"), (None, "only here"), (None, "only here"), (12, "x\0y"),
        (13, "x\0Y"), (14, "Word " * 40_000), (15, "wORD " * 40_000), (16, "word " * 40_001), (17, "tie"), (17, "TIE"),
        (17, "tie"), (-3, "Same text"), *[(100 + i, "Hot Copy") for i in range(300)]]


def brute(rows, keep):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOW)].append(d)
    pick = min if keep == "smallest" else max
    out = Counter()
    for t, ids in groups.items():
        k = pick((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("content_hash", [exact_dedup.CONTENT_HASH, "cast(length(body) % 2 as int)"])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep, content_hash):
    docs = spark.createDataFrame([(d, t, "h", "b", "k", 1, 2, "d") for d, t in ROWS], DOC)
    got = exact_dedup.exact_duplicates(docs, keep, content_hash=content_hash).collect()
    want = brute(ROWS, keep)
    assert Counter(tuple(r)[:5] for r in got) == want
    one = exact_dedup.drop_duplicates(docs, keep, content_hash=content_hash)
    assert one.columns == DOC.names
    low = Counter((r["doc_id"], (r["text"] or "").translate(LOW)) for r in one.collect())
    assert max(low.values()) == 1 and len(low) == len({s for *_, s in want})
    assert {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in low} == {(d, s) for d, _, _, kept, s in want if kept}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_duplicates(docs).count() == 0 and exact_dedup.drop_duplicates(docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_exact_dedup"](spark, sf)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, "largest")
