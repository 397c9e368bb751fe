"""Line deduplication by an exact set-similarity join.

A line's words lie between ASCII white space; its set holds the distinct words
as they are written.  A line is removed when an earlier line (by doc_id, then
line number) has a set of Jaccard similarity ``threshold`` or more; blank
lines are never removed.  Only DataFrame operations are used.

* Words are ordered by rarity: all words are counted in ``RARITY_BUCKETS``
  hashed counters, and the logarithm of a word's counter, then its hash, gives
  its place.  Any common order keeps the join exact; this one keeps the
  buckets of shared words short.
* Lines of equal sets form one class, known by its first line; sets so small
  that only equal ones match end there.
* A class of n words that matches another shares a word within its first
  n - ceil(threshold * n) + 1 words (prefix filter).  Classes meet at such a
  word as narrow rows; length, position of the word and the parity bits of the
  sets (each word flips one of 64, in sets of ``WIDE`` words or more one of
  128) drop pairs that cannot reach the threshold, and so does the number of
  words at which a pair meets.
* A word that more than ``SHORT_BUCKET`` classes share first pairs them with
  its earliest class only; those that this does not remove are then paired
  with all earlier ones.  So near copies of one line never become all pairs.
* Pairs are verified on the words themselves, read again from the texts of the
  lines concerned: first the likeliest partner of each class, then all others
  of the classes that this does not remove.

Defined results: null and empty texts have no lines to remove; rows equal in
doc_id and text are one document and get the same result; null doc_ids come
last, ties between texts of one doc_id go by a hash of the text; other columns
pass through ``dedup_lines`` untouched, but for one named like its count, which
the count replaces; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaflow.llm.common import Scratch, literal_array, runtime_filters, sized, unsized

THRESHOLD = 0.8
RARITY_BUCKETS = 1 << 19
NO_ID = (1 << 63) - 1
SHORT_BUCKET = 256
HASH_BITS = 57  # of a word's place, below its 6 bits of rarity
CODE_BITS = 44
WIDE = 48  # words from which a set's parity bits are 128


def _spaced(text: str) -> str:
    """White space inside lines as single-character spaces; the common case
    without tabs or carriage returns is left alone."""
    return (f"if({text} rlike '[\\\\x09\\\\x0B-\\\\x0D]', "
            f"translate({text}, '\\t\\u000B\\f\\r', '    '), {text})")


def _rows(docs: DataFrame) -> DataFrame:
    """Documents as (doc, tk, body): order key, tie-breaking text hash, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("tk"), text.alias("body"))


def _lines(docs: DataFrame) -> DataFrame:
    rows = _rows(docs).selectExpr("doc", "tk", f"{_spaced('body')} as body")
    return rows.selectExpr("doc", "tk", "posexplode(split(body, '\\n')) as (line_no, line)")


def rarity_levels(docs: DataFrame, buckets: int = RARITY_BUCKETS) -> list[int]:
    """Twice the binary logarithm of the word count of every hash bucket (a
    list of ``buckets``, a power of two, numbers below 64, whatever the input)."""
    words = (_rows(docs).selectExpr(f"explode(split(replace({_spaced('body')}, '\\n', ' '), ' ')) as w")
             .filter("w <> ''").selectExpr(f"cast(pmod(xxhash64(w), {buckets}) as int) as b"))
    level = "least(63, cast(2 * log2(n) as int))"
    packed = (words.groupBy("b").agg(F.count(F.lit(1)).alias("n")).selectExpr("b div 4096 as block", f"b * 64 + {level} as x")
              .groupBy("block").agg(F.collect_list("x").alias("xs")))  # at most 4096 numbers a row
    out = [0] * buckets
    for r in packed.collect():
        for x in r["xs"]:
            out[x >> 6] = x & 63
    return out


def _sets(lines: DataFrame, levels: list[int], threshold: float) -> DataFrame:
    """Per line: 128-bit key of the set (k1, k2), size n, the parity bits of all
    its words and, from ``WIDE`` words, of about half of them, and prefix words
    as numbers of 6 + ``CODE_BITS`` bits."""
    # never null, so that Spark sorts plain longs
    code = (f"(shiftleft(cast(coalesce(get({literal_array(levels, 'tinyint')}, cast(h & {len(levels) - 1}L as int)), 0Y) as bigint), {HASH_BITS})"
            f" | (h & {(1 << HASH_BITS) - 1}L))")
    words = "array_distinct(transform(array_remove(split(line, ' '), ''), w -> xxhash64(w)))"
    return (lines.filter("trim(line) <> ''")
            .selectExpr("doc", "tk", "line_no", f"sort_array(transform({words}, h -> {code})) as codes")
            .selectExpr("doc", "tk", "line_no", "size(codes) as n", "xxhash64(codes) as k1", "xxhash64(17, codes) as k2",
                        "aggregate(codes, 0L, (a, c) -> a ^ shiftleft(1L, cast(c & 63 as int))) as odd",
                        f"if(size(codes) < {WIDE}, 0L, aggregate(codes, 0L, (a, c) -> a ^ shiftleft(shiftright(c, 6) & 1L, cast(c & 63 as int)))) as half",
                        f"if(size(codes) / (size(codes) + 1D) >= {threshold}D - 1e-9D, transform(slice(codes, 1, "
                        f"{_prefix('size(codes)', threshold)}), c -> shiftright(c, {HASH_BITS - CODE_BITS})), null) as prefix"))


def _least(x: str, threshold: float) -> str:
    """Smallest integer not below threshold * x, safe against rounding."""
    return f"cast(ceil({threshold}D * {x} - 1e-9D) as int)"


def _prefix(n: str, threshold: float) -> str:
    return f"{n} - {_least(n, threshold)} + 1"


def _overlap(n1: str, n2: str, threshold: float) -> str:
    """Least number of common words of sets of n1 and n2 words that match."""
    return f"cast(ceil({threshold}D / (1D + {threshold}D) * ({n1} + {n2}) - 1e-9D) as int)"


def _close(a: str, b: str, threshold: float) -> str:
    """Whether two rows that share the words at places p (from 0) of their
    orders can match: the parity bits differ in no more places than the sets
    in words, and length and position leave enough words to share."""
    least = _overlap(f"{a}.n", f"{b}.n", threshold)
    return (f"{_spare(a, b, threshold)} >= 0 and {a}.n >= {_least(f'{b}.n', threshold)} and {b}.n >= {_least(f'{a}.n', threshold)} and "
            f"least({a}.p, {b}.p) + 1 + least({a}.n - {a}.p - 1, {b}.n - {b}.p - 1) >= {least}")


def _spare(a: str, b: str, threshold: float) -> str:
    """How many more words the sets of a match may differ in than their parity
    bits do: 128 bits if both sets have them, else 64."""
    odd, half = f"{a}.odd ^ {b}.odd", f"{a}.half ^ {b}.half"
    bits = f"if(least({a}.n, {b}.n) < {WIDE}, bit_count({odd}), bit_count({odd} ^ {half}) + bit_count({half}))"
    return f"{a}.n + {b}.n - 2 * {_overlap(f'{a}.n', f'{b}.n', threshold)} - {bits}"


def _place() -> Column:
    return F.struct("doc", "tk", "line_no")


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, threshold: float, scratch: Scratch,
              name: str) -> DataFrame:
    """Keys (k1, k2) of the classes x that a pair (x, y) shows to match an
    earlier class y.  Pairs name classes by half of their key; their first
    lines are read from the documents, and the words decide."""
    named = pairs.select(F.col("x").alias("k1")).unionByName(pairs.select(F.col("y").alias("k1"))).distinct()
    scratch.write(firsts.join(named, "k1").select("k1", "k2", "n", "first.*"), f"needed-{name}")
    needed = docs.sparkSession.read.parquet(scratch.path(f"needed-{name}")).filter("line_no >= 0")
    # repeated documents come out once; a name that two classes share keeps both
    found = (_lines(docs).join(sized(needed), ["doc", "tk", "line_no"])
             .groupBy("k1").agg(F.collect_set(F.struct("k2", _place().alias("place"), "n", "line")).alias("c")))
    both = (pairs.select("x", "y").join(found.select(F.col("k1").alias("x"), F.col("c").alias("cx")), "x")
            .join(found.select(F.col("k1").alias("y"), F.col("c").alias("cy")), "y")
            .select("x", F.explode("cx").alias("cx"), "cy").select("x", "cx", F.explode("cy").alias("cy")).filter("cy.place < cx.place")
            .filter("size(array_intersect(array_remove(split(cx.line, ' '), ''), split(cy.line, ' '))) >= "
                    f"{threshold}D / (1D + {threshold}D) * (cx.n + cy.n) - 1e-9D").select(F.col("x").alias("k1"), "cx.k2"))
    with runtime_filters(docs.sparkSession):
        gone = scratch.write(both.select("k1", "k2").distinct(), f"gone-{name}")
    scratch.drop(f"needed-{name}")
    return gone


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, short: int = SHORT_BUCKET) -> DataFrame:
    """(doc, tk, removed): per document that loses lines, their numbers from 0
    in ascending order.  ``doc`` is doc_id (null as the largest value), ``tk``
    the hash of the text."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.write(_sets(_lines(docs), rarity_levels(docs), threshold), "lines")
    classes = scratch.write(lines.groupBy("k1", "k2").agg(
        F.min(_place()).alias("first"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("half").alias("half"), F.first("prefix").alias("prefix")), "classes")
    keys = scratch.write(lines.select("doc", "tk", "line_no", "k1", "k2"), "keys")
    scratch.drop("lines")

    # classes x at the words that they share with earlier ones y; long buckets apart
    post = classes.filter("prefix is not null").selectExpr("k1", "n", "odd", "half", "first.doc", "posexplode(prefix) as (p, code)")
    long = scratch.write(post.groupBy("code").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > short).select("code"), "long")
    rows = post.join(long, "code", "left_anti")
    earlier = F.expr(f"b.doc <= a.doc and a.k1 <> b.k1 and {_close('a', 'b', threshold)}")
    # A match shares at least ``least`` words in the prefixes: all but what lies
    # beyond one of them.  Half of these lie in short or half in long buckets.
    least = f"{_overlap('a.n', 'b.n', threshold)} - greatest({_least('a.n', threshold)}, {_least('b.n', threshold)}) + 1"

    def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
        at = a.alias("a").join(b.alias("b"), (F.col("a.code") == F.col("b.code")) & earlier)
        return (at.select(F.col("a.k1").alias("x"), F.col("b.k1").alias("y"), F.expr(_spare("a", "b", threshold)).alias("spare"),
                          F.expr(least).alias("least")).groupBy("x", "y")
                .agg(F.max("spare").alias("spare"), F.max("least").alias("least"), F.count(F.lit(1)).alias("votes"))
                .filter("2 * votes >= least").select("x", "y", "spare"))

    shared = scratch.write(post.join(long, "code", "left_semi"), "shared")
    hubs = shared.groupBy("code").agg(F.min(F.struct("doc", "k1", "n", "p", "odd", "half")).alias("h")).select("code", "h.*")
    pairs = meeting(rows, unsized(rows)).unionByName(meeting(shared, hubs))
    pairs = scratch.write(pairs.groupBy("x", "y").agg(F.max("spare").alias("spare")), "pairs")
    firsts = scratch.write(classes.select("k1", "k2", "n", "first"), "firsts")
    scratch.drop("lines", "classes", "long")

    # the likeliest partner of each class decides for most, then all others
    best = pairs.groupBy("x").agg(F.max(F.struct("spare", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
    best = scratch.write(best, "best")
    gone = _verified(best, firsts, docs, threshold, scratch, "1")
    settled = gone.select(F.col("k1").alias("x")).distinct()
    left = shared.join(gone.select("k1").distinct(), "k1", "left_anti")
    more = pairs.unionByName(meeting(left, shared)).select("x", "y")
    more = more.distinct().join(settled, "x", "left_anti").join(best, ["x", "y"], "left_anti")
    more = scratch.write(more, "more")
    gone = gone.unionByName(_verified(more, firsts, docs, threshold, scratch, "2")).distinct()

    state = scratch.write(firsts.join(gone.withColumn("gone", F.lit(True)), ["k1", "k2"], "left"), "state")
    scratch.drop("shared", "pairs", "best", "more", "firsts", "gone-1", "gone-2")
    return (keys.join(state, ["k1", "k2"]).filter(F.col("gone").isNotNull() | (_place() != F.col("first")))
            .groupBy("doc", "tk").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, count: str = "n_removed") -> DataFrame:
    """``docs`` with the removed lines cut from ``text`` and the number of
    lines cut in the column ``count``."""
    gone = removed_lines(docs, threshold)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).select(
        "d", F.coalesce(F.col("d.doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))).alias("tk"))
    joined = (rows.join(gone, ["doc", "tk"], "left")
              .select("d", "removed", F.expr("if(removed is null, null, split(d.text, '\\n'))").alias("ls"))
              .select("d", "removed", "ls", F.expr("array_except(sequence(0, size(ls) - 1), removed)").alias("kept")))
    text = F.expr("if(removed is null, d.text, array_join(transform(kept, i -> ls[i]), '\\n'))")
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c != count],
        F.coalesce(F.size("removed"), F.lit(0)).alias(count))
