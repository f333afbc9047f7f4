"""Exact percentiles of bounded memory, next to any other metric of the same groups.

Rows are first reduced to one row per group and distinct value, with counts and the partial results of all other metrics:
one exchange, combined map-side.  The value range is cut into chunks that follow the order of values; chunk totals tell
which chunk holds the rank that is asked for, and only the rows of that chunk are ranked.  So no buffer grows with a group,
and a group with a third of all rows is spread over as many tasks as it has values.

All readers of the reduced rows ask for all of its columns, so that adaptive execution runs that exchange once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Chunks per e-fold of a value: a chunk is about 0.1 % wide, or 0.001 near zero.
CHUNKS = 1024
_FIRST, _LAST = -(2**62), 2**62


def metric(op: str, column: str | None = None) -> Column:
    """count, sum, avg, max or min of a column."""
    if op == "count":
        return F.count(F.lit(1))
    if op not in ("sum", "avg", "max", "min"):
        raise ValueError(f"no such metric: {op}")
    return getattr(F, op)(column)


def partial(op: str, column: str | None, name: str) -> list[Column]:
    """Columns from which ``merged`` gets the metric of any union of groups."""
    if op == "avg":
        return [F.sum(F.col(column).cast("double")).alias(f"{name}__sum"), F.count(column).alias(f"{name}__n")]
    return [metric(op, column).alias(f"{name}__{op}")]


def merged(op: str, name: str) -> Column:
    if op == "avg":
        return F.sum(f"{name}__sum") / F.sum(f"{name}__n")
    return {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[op](f"{name}__{op}")


def chunk_of(value: Column) -> Column:
    """Number of the chunk of a value: never falls as values rise; NaN comes last, as in ordering."""
    place = F.least(F.greatest(F.signum(value) * F.log1p(F.abs(value)) * CHUNKS, F.lit(-1e9)), F.lit(1e9))
    return F.coalesce(F.when(F.isnan(value), F.lit(_LAST)).otherwise(F.floor(place).cast("long")), F.lit(_FIRST))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def whole(df: DataFrame) -> DataFrame:
    """Always true, but reads every column: readers stay alike, so their exchange is shared."""
    return df.where(F.pmod(F.hash(*df.columns), F.lit(1)) == 0)


def _select(reduced: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles per group from (keys, __v, __n): linear interpolation between the two ranks around each share."""
    rows = whole(reduced).select(*keys, "__v", "__n", chunk_of(F.col("__v")).alias("__c"))
    groups = [F.col(k) for k in keys] or [F.lit(1)]
    before = Window.partitionBy(*groups).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, "__c").agg(F.sum("__n").alias("__size")).select(
        *keys, "__c", "__size", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy(*groups)).alias("__total"))
    place = {name: (F.col("__total") - 1) * F.lit(share) for name, share in shares.items()}
    ends = {name: (F.floor(p), F.ceil(p)) for name, p in place.items()}
    holds = lambda r, begin, size: (r >= begin) & (r < begin + size)
    wanted = chunks.where("__total > 0").where(reduce(
        lambda a, b: a | b, [holds(r, F.col("__before"), F.col("__size")) for pair in ends.values() for r in pair]))
    inside = rows.alias("r").join(wanted.alias("w"), _same("r", "w", keys) & (F.col("r.__c") == F.col("w.__c"))).select(
        *[F.col(f"r.{k}").alias(k) for k in keys], F.col("r.__c").alias("__c"), "__v", "__n", "__before", "__total")
    along = Window.partitionBy(*groups, F.col("__c")).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("__at", F.col("__before") + F.coalesce(F.sum("__n").over(along), F.lit(0)))
    at = {(name, i): F.max(F.when(holds(r, F.col("__at"), F.col("__n")), F.col("__v")))
          for name, pair in ends.items() for i, r in enumerate(pair)}
    picked = ranked.groupBy(*keys).agg(
        F.max("__total").alias("__total"), *[c.alias(f"__{name}_{i}") for (name, i), c in at.items()])
    between = {}
    for name, p in place.items():
        low, high = F.col(f"__{name}_0"), F.col(f"__{name}_1")
        between[name] = F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)
    return picked.select(*keys, *[c.alias(name) for name, c in between.items()])


def share_of(op: str) -> float:
    return int(op.split("_", 1)[1]) / 100


def aggregate(df: DataFrame, keys: Sequence[str], metrics: dict[str, tuple]) -> DataFrame:
    """(keys, metrics): each metric is (op, column), op as in ``metric`` or percentile_N, exact with interpolation."""
    keys = list(keys)
    wanted: dict[str, dict[str, float]] = {}
    plain = {}
    for name, (op, *column) in metrics.items():
        if op.startswith("percentile_"):
            wanted.setdefault(column[0], {})[name] = share_of(op)
        else:
            plain[name] = (op, column[0] if column else None)
    if not wanted:
        return df.groupBy(*keys).agg(*[metric(*spec).alias(name) for name, spec in plain.items()])
    out = None
    for column, shares in wanted.items():
        mine = plain if out is None else {}
        # Grouped by the value as it is; an empty input still gives its one row where there are no keys.
        reduced = df.withColumn("__v", F.col(column).cast("double")).groupBy(*keys, "__v").agg(
            F.count("__v").alias("__n"), *[c for name, spec in mine.items() for c in partial(*spec, name)])
        selected = _select(reduced, keys, shares)
        if out is None:
            rest = whole(reduced).groupBy(*keys).agg(
                F.sum("__n").alias("__rows"), *[merged(op, name).alias(name) for name, (op, _) in mine.items()])
            if not keys:  # counts of nothing are 0, not absent
                rest = rest.select("__rows", *[(F.coalesce(name, F.lit(0)) if plain[name][0] == "count" else F.col(name)).alias(name) for name in mine])
            out = rest
        out = out.alias("a").join(selected.alias("b"), _same("a", "b", keys), "left").select(
            "a.*", *[F.col(f"b.{name}") for name in shares])
    return out.select(*keys, *metrics)


def weighted_percentiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles per group of values that each stand ``weight`` times; groups of nothing but nulls are null."""
    reduced = df.withColumn("__v", F.col(value).cast("double")).groupBy(*keys, "__v").agg(
        F.sum(F.when(F.col("__v").isNotNull(), F.col(weight)).otherwise(0)).alias("__n"))
    groups = whole(reduced).groupBy(*keys).agg(F.sum("__n").alias("__rows"))
    return groups.alias("a").join(_select(reduced, list(keys), shares).alias("b"), _same("a", "b", keys), "left").select(
        *[F.col(f"a.{k}") for k in keys], *[F.col(f"b.{name}") for name in shares])
