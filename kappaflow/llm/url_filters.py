"""URL filters that change over time.

List entries are dated: from ``listed_on`` on, an entity of a kind is blocked
or allowed ("block", "allow") or taken off the list ("drop"), until its next
entry.  Entries become validity intervals, and an as-of join evaluates every
capture against the intervals that hold its fetch time; the most specific kind
on the list decides (url, then host, then domain).

Intervals of an entity do not overlap, so each kind is one left join that adds
no rows.  Its key includes the month: an interval has one row for each month
it touches within the captures' span, so a capture meets only entries of its
own month however long its entity's history is.  Only DataFrame operations
are used.  Captures of one host are plain probe rows, which adaptive execution
splits; an entity has at most one interval a day.

Defined results: a null or unreadable URL or a null time gets decision "none";
entries without kind, entity, date or known action are ignored; of entries for
one entity and day, block goes before allow and allow before drop; repeated
captures each get a row; the input's columns come back under their names, and
a result column whose name the input has gets "_" after it until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("url", "host", "domain")


def host_of(url: Column) -> Column:
    """Lower-case host, without user, port or a closing dot; null if none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def entity(kind: str, url: Column) -> Column:
    """What an entry of ``kind`` names: the URL without scheme and fragment,
    its host, or the last two labels of the host."""
    if kind == "url":
        rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*", ""), "#.*$", "")
        return F.concat(host_of(url), rest)
    if kind == "host":
        return host_of(url)
    return F.nullif(F.regexp_extract(host_of(url), r"([^.]+\.[^.]+)$", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, entity, action, valid_from, valid_to): valid_to is the next
    entry's date, null for the last; "drop" entries only end intervals."""
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "drop", 2)
    daily = (entries.select("kind", "entity", F.col("listed_on").cast("date").alias("valid_from"), rank.alias("r"))
             .dropna().groupBy("kind", "entity", "valid_from").agg(F.min("r").alias("r")))
    later = F.lead("valid_from").over(Window.partitionBy("kind", "entity").orderBy("valid_from"))
    return (daily.withColumn("valid_to", later).filter("r < 2")
            .select("kind", "entity", F.when(F.col("r") == 0, "block").otherwise("allow").alias("action"),
                    "valid_from", "valid_to"))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with decision ("block", "allow" or "none"), kind,
    valid_from and valid_to of the entry that decided."""
    spans = captures.agg(F.min(F.to_date(fetched)).alias("a"), F.max(F.to_date(fetched)).alias("b")).first()
    held = intervals(entries)
    lo, hi = (F.lit(x).cast("date") for x in (spans["a"], spans["b"]))
    held = (held.filter((F.col("valid_from") <= hi) & (F.col("valid_to").isNull() | (F.col("valid_to") > lo)))
            .withColumn("month", F.explode(F.sequence(
                _month(F.greatest("valid_from", lo)), _month(F.least(F.coalesce("valid_to", hi), hi))))))
    day = F.to_date(F.col("c")[fetched])
    out = captures.select(F.struct(*[F.col(f"`{x}`") for x in captures.columns]).alias("c"))
    out = out.select("c", day.alias("day"), _month(day).alias("month"),
                     *[entity(k, F.col("c")[url]).alias(f"e_{k}") for k in KINDS])
    for k in KINDS:
        one = held.filter(F.col("kind") == k).select(
            F.col("entity").alias(f"e_{k}"), "month",
            F.struct(F.col("action").alias("decision"), "kind", "valid_from", "valid_to").alias(f"m_{k}"))
        hit = ((F.col(f"o.e_{k}") == F.col(f"i.e_{k}")) & (F.col("o.month") == F.col("i.month"))
               & (F.col(f"i.m_{k}.valid_from") <= F.col("o.day"))
               & (F.col(f"i.m_{k}.valid_to").isNull() | (F.col("o.day") < F.col(f"i.m_{k}.valid_to"))))
        out = out.alias("o").join(one.alias("i"), hit, "left").select("o.*", F.col(f"i.m_{k}"))
    m = F.coalesce(*[F.col(f"m_{k}") for k in KINDS])
    names: dict[str, str] = {}
    taken = {x.lower() for x in captures.columns}
    for x in ("decision", "kind", "valid_from", "valid_to"):
        names[x] = x
        while names[x].lower() in taken:
            names[x] += "_"
        taken.add(names[x].lower())
    return out.select(*[F.col("c")[x].alias(x) for x in captures.columns],
                      F.coalesce(m["decision"], F.lit("none")).alias(names["decision"]),
                      *[m[x].alias(names[x]) for x in ("kind", "valid_from", "valid_to")])
