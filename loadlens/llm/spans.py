"""Spans of pattern matches in whole texts, in code points, with column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,s:int,e:int,m:string,before:string,ok:boolean,value:string>>"


def find(
    text: Column, pattern: str, kind: int, ok: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None,
    group: int = 0, context: int = 24,
) -> Column:
    """All leftmost non-overlapping matches as structs.

    The text is split at the matches; the lengths of the parts and of the matches give the places.  ``ok`` tells whether
    a match's ``value`` (its ``group``) is valid; ``keep`` (all by default) limits which matches are returned.
    ``before`` is what stands up to ``context`` characters before the match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.split(text, pattern, -1)

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), x["m"].alias("m"),
            F.right(x["p"], F.lit(context)).alias("before"), ok(x["v"]).alias("ok"), x["v"].alias("value"))
        spans = F.concat(acc["spans"], F.array(span))
        if keep is not None:
            spans = F.when(keep(x["v"]), spans).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    matches = F.transform(
        F.arrays_zip(parts.alias("p"), found.alias("m"), values.alias("v")),
        lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), x["v"].alias("v")))
    none = F.array().cast(SPAN)
    folded = F.aggregate(
        F.slice(matches, F.lit(1), F.size(found)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(pattern), folded).otherwise(none)


def ordered(spans: Column) -> Column:
    """By start, then kind."""
    return F.array_sort(spans, lambda x, y: F.when(x["s"] != y["s"], F.when(x["s"] < y["s"], -1).otherwise(1)).otherwise(
        F.when(x["kind"] < y["kind"], -1).when(x["kind"] > y["kind"], 1).otherwise(0)))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(ordered(spans), lambda x: F.concat(
        F.element_at(names, x["kind"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
