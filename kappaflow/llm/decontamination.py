"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so what counts is containment: the
share of an item's distinct five-word shingles that a document has (words
lower-cased, between ASCII white space).  An item is found in a document when
its containment is ``threshold`` or more.  Only DataFrame operations are used.

* Items are partitioned by size: those of 2**s to 2**(s+1) - 1 shingles form
  partition s.  Its items are known by the k smallest hash values of their
  sets (their bottom-k MinHash), with k one more than the shingles that the
  largest item of the partition may lack.  A document that contains enough of
  an item thus has at least k - floor((1 - threshold) * n) of them: the search
  loses nothing, and a longer item needs a smaller share of its shingles.
* Document shingles meet the table of these values (one row per item and
  value; broadcast only when its row count is below ``BROADCAST_ROWS``).
  Documents with enough of an item's values are candidates.
* Candidates are verified on the shingles themselves.
* An item of fewer than five words has its whole word sequence as its one
  shingle.  Where such items exist, documents also have the shingles of their
  lengths (of one to four words), so that they are found inside long texts.

Defined results: null and blank texts contain nothing and are contained in
nothing; a document of fewer than five words has its whole word sequence as a
shingle, too; rows equal in doc_id and text are reported once;
null ids are kept; a long document is one row of hashes, never of pairs; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaflow.llm.common import Scratch, runtime_filters, unsized

THRESHOLD = 0.75
BROADCAST_ROWS = 1_000_000

_WORDS = "filter(split(translate(lower(coalesce(text, '')), '\\n\\t\\u000B\\f\\r', '     '), ' '), w -> w <> '')"
_FIVE = "slice(ws, 1, size(ws) - 4)"


def _words(rows: DataFrame) -> DataFrame:
    """Adds ``ws``; the usual text without odd white space skips translate."""
    plain = "filter(split(replace(lower(coalesce(text, '')), '\\n', ' '), ' '), w -> w <> '')"
    return rows.withColumn("ws", F.expr(f"if(text rlike '[\\\\x09\\\\x0B-\\\\x0D]', {_WORDS}, {plain})")).drop("text")


def _runs(m: int, value: str, kind: str) -> str:
    """``value`` of every run ``g`` of ``m`` words of a longer text."""
    run = "concat_ws(' ', w" + "".join(f", ws[i + {j}]" for j in range(1, m)) + ")"
    return (f"case when size(ws) > {m} then transform(slice(ws, 1, size(ws) - {m - 1}), (w, i) -> {value.format(g=run, m=m)}) "
            f"else cast(array() as array<{kind}>) end")


def _hashes(sizes: Sequence[int] = ()) -> str:
    """Hash of every shingle, with repeats; ``sizes`` are the lengths below
    five words that are wanted as well."""
    whole = ("case when size(ws) >= 5 then transform("
             f"{_FIVE}, (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) "
             "when size(ws) > 0 then array(xxhash64(array_join(ws, ' '), size(ws))) else cast(array() as array<bigint>) end")
    return f"concat({', '.join([whole, *[_runs(m, 'xxhash64({g}, {m})', 'bigint') for m in sizes]])})"


def _shingles(sizes: Sequence[int] = ()) -> str:
    whole = ("case when size(ws) >= 5 then transform("
             f"{_FIVE}, (w, i) -> concat_ws(' ', w, ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) "
             "when size(ws) > 0 then array(array_join(ws, ' ')) else cast(array() as array<string>) end")
    return f"array_distinct(concat({', '.join([whole, *[_runs(m, '{g}', 'string') for m in sizes]])}))"


def short_sizes(items: DataFrame) -> list[int]:
    """The item lengths below five words that occur (at most four numbers)."""
    sizes = _words(items.select("text")).selectExpr("size(ws) as m").filter("m between 1 and 4").distinct()
    return sorted(r["m"] for r in sizes.collect())


def _may_lack(n: str, threshold: float) -> str:
    """Most shingles of ``n`` that a containing document may lack."""
    return f"cast(floor((1D - {threshold}D) * {n} + 1e-9D) as int)"


def signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_key, n, needed, h): the bottom-k hash values of every item and
    how many of them a containing document has at least."""
    sets = _words(items.select("item_key", "text")).selectExpr("item_key", f"array_sort(array_distinct({_hashes()})) as hs")
    sized = sets.filter("size(hs) > 0").selectExpr(
        "item_key", "size(hs) as n", "hs",
        f"{_may_lack('(shiftleft(1, cast(floor(log2(size(hs) + 0.5D)) as int) + 1) - 1)', threshold)} + 1 as k")
    return sized.selectExpr("item_key", "n", f"least(k, n) - {_may_lack('n', threshold)} as needed",
                            "explode(slice(hs, 1, k)) as h")


def _keyed(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    return rows.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tk"),
                       F.col(text).alias("text"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, tk, item_id, n_shared, n_item, containment) of every document
    (doc_id and hash of its text) and item that it contains."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = scratch.write(items.select("item_id", "text").withColumn("item_key", F.monotonically_increasing_id()), "items")
    sig = scratch.write(signatures(items, threshold), "signatures")
    sizes = short_sizes(items)
    probe = sig.select("item_key", "needed", "h")
    probe = F.broadcast(probe) if probe.count() <= BROADCAST_ROWS else unsized(probe)
    keyed = _keyed(docs, "doc_id", "text")
    found = (_words(keyed).selectExpr("doc_id", "tk", f"explode({_hashes(sizes)}) as h").join(probe, "h")
             .groupBy("doc_id", "tk", "item_key", "h").agg(F.max("needed").alias("needed"))
             .groupBy("doc_id", "tk", "item_key").agg(F.count(F.lit(1)).alias("m"), F.max("needed").alias("needed"))
             .filter("m >= needed"))
    # the written size lets Spark broadcast the wanted documents while they are
    # few; else the condition, stated again, makes them a runtime filter's source
    found = scratch.write(found, "candidates").filter("m >= needed").select("doc_id", "tk", "item_key")

    wanted = found.select("doc_id", "tk").distinct()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tk") == F.col(f"{b}.tk"))
    bodies = keyed.alias("k").join(wanted.alias("w"), same("k", "w"), "left_semi").dropDuplicates(["doc_id", "tk"])
    bodies = _words(bodies).selectExpr("doc_id", "tk", f"{_shingles(sizes)} as ds")
    with runtime_filters(docs.sparkSession):
        bodies = scratch.write(bodies, "bodies")
    sets = scratch.write(_words(items).selectExpr("item_key", "item_id", f"{_shingles()} as qs"), "sets")
    pairs = (found.alias("f").join(bodies.alias("b"), same("f", "b")).select("f.*", "b.ds").join(sets, "item_key")
             .selectExpr("doc_id", "tk", "item_id", "size(array_intersect(ds, qs)) as n_shared", "size(qs) as n_item"))
    return (pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .filter(f"n_shared >= n_item - {_may_lack('n_item', threshold)}"))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that contain a test item.  The list of those is
    written, so that Spark knows its size: while it is small no text moves."""
    hits = contained(docs, items, threshold).select(F.col("doc_id").alias("hit_id"), F.col("tk").alias("hit_tk")).distinct()
    hits = Scratch(docs.sparkSession, "decontamination-hits").write(hits, "hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    keep = rows.join(hits, F.col("d.doc_id").eqNullSafe(F.col("hit_id"))
                     & (F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("hit_tk")), "left_anti")
    return keep.select(*[F.col(f"d.`{c}`") for c in docs.columns])
