"""Time-series operators over metric samples: ``samples(ts, metric, labels MAP, value)``.

Series are cut into time chunks before anything is ordered.  A window only ever sorts one chunk of
one series; what crosses a chunk border is one row per chunk.  So a series that holds a third of all
samples is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_LONGEST_CHUNK = 3600


def seconds_of(every: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", every)
    if not found:
        raise ValueError(f"not an interval: {every!r}")
    return int(found[1]) * _UNITS[found[2]]


def label(name: str) -> Column:
    return F.try_element_at(F.col("labels"), F.lit(name))


def select_series(samples: DataFrame, metrics: Sequence[str], equal: dict | None = None, match: dict | None = None) -> DataFrame:
    """Samples of some metrics whose labels are equal to, or fully match, the given ones."""
    df = samples.where(F.col("metric").isin(list(metrics)))
    for name, value in (equal or {}).items():
        df = df.where(label(name) == value)
    for name, pattern in (match or {}).items():
        df = df.where(label(name).rlike(f"^(?:{pattern})$"))
    return df


def _with_series(samples: DataFrame) -> DataFrame:
    """Label sets as one comparable key."""
    entries = F.array_sort(F.map_entries("labels"))
    return samples.withColumn("series", F.to_json(entries))


def _advance(value: Column, before: Column) -> Column:
    """Growth of a counter from ``before``; after a reset it has grown by its whole value."""
    return F.when(value < before, value).otherwise(value - before)


def gauge(samples: DataFrame, every: str = "1 hour") -> DataFrame:
    """Last value of each series per time bin: (t, metric, series, labels, value)."""
    t = F.window("ts", every)["start"].alias("t")
    return _with_series(samples).groupBy(t, "metric", "series").agg(
        F.any_value("labels").alias("labels"), F.max_by("value", "ts").alias("value")
    )


def counter_rate(samples: DataFrame, every: str = "1 hour") -> DataFrame:
    """Growth per second of each counter per time bin, reset-aware, not extrapolated.

    A step between two samples belongs to the bin of the later one.
    """
    width = seconds_of(every)
    chunk = width if width <= _LONGEST_CHUNK or width % _LONGEST_CHUNK else _LONGEST_CHUNK
    keyed = _with_series(samples).withColumn("chunk", F.window("ts", f"{chunk} seconds")["start"])
    order = Window.partitionBy("metric", "series", "chunk").orderBy("ts")
    steps = keyed.withColumn("step", _advance(F.col("value"), F.lag("value").over(order)))
    # Same keys as the window: no further shuffle.
    chunks = steps.groupBy("metric", "series", "chunk").agg(
        F.any_value("labels").alias("labels"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("inside"),
        F.min_by("value", "ts").alias("first"),
        F.max_by("value", "ts").alias("last"),
    )
    across = F.lag("last").over(Window.partitionBy("metric", "series").orderBy("chunk"))
    grown = chunks.withColumn(
        "grown", F.col("inside") + F.coalesce(_advance(F.col("first"), across), F.lit(0.0))
    )
    t = F.window("chunk", every)["start"].alias("t")
    return grown.groupBy(t, "metric", "series").agg(
        F.any_value("labels").alias("labels"), (F.sum("grown") / width).alias("value")
    )


def aggregate_by(series: DataFrame, labels: Sequence[str], fn: str = "sum", extra: Sequence[str] = ()) -> DataFrame:
    """sum, avg, max, min or count over series, per step and labels."""
    value = F.count("value") if fn == "count" else getattr(F, fn)("value")
    return series.groupBy("t", *extra, *[label(name).alias(name) for name in labels]).agg(value.alias("value"))


def healthy(series: DataFrame, labels: Sequence[str]) -> DataFrame:
    """How many series are up (value 1) out of how many, per step and labels."""
    return series.groupBy("t", *[label(name).alias(name) for name in labels]).agg(
        F.count_if(F.col("value") == 1).alias("up"), F.count("value").alias("total")
    )


def combine(a: DataFrame, b: DataFrame, how: str, on: Sequence[str] = ("t",)) -> DataFrame:
    """Arithmetic of two aligned series: 'ratio' or 'difference'."""
    joined = a.withColumnRenamed("value", "__a").join(b.withColumnRenamed("value", "__b"), list(on))
    value = F.col("__a") - F.col("__b") if how == "difference" else F.try_divide("__a", "__b")
    return joined.select(*on, value.alias("value"))


def histogram_quantiles(buckets: DataFrame, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(t, by, line, value): all named quantiles from cumulative bucket rates with label ``le``, in one pass.

    Linear inside the bucket that holds the rank.  Beyond the last finite bound the answer is that bound; an empty
    histogram has none.
    """
    bound = F.when(label("le") == "+Inf", F.lit(float("inf"))).otherwise(label("le").try_cast("double"))
    summed = buckets.groupBy("t", *[label(name).alias(name) for name in by], bound.alias("bound")).agg(
        F.sum("value").alias("cum")
    )
    keys = ("t", *by)
    order = Window.partitionBy(*keys).orderBy("bound")
    placed = summed.select(
        *keys, "bound", "cum",
        F.lag("bound").over(order).alias("below"),
        F.coalesce(F.lag("cum").over(order), F.lit(0.0)).alias("before"),
        F.max("cum").over(Window.partitionBy(*keys)).alias("total"),
    )
    bucket = F.struct("bound", "below", "before", "cum", "total")
    holding = placed.where(F.col("total") > 0).groupBy(*keys).agg(*[
        F.min_by(bucket, F.when(F.col("cum") >= F.col("total") * q, F.col("bound"))).alias(f"__{name}")
        for name, q in shares.items()
    ])

    def value(b: Column, q: float) -> Column:
        start = F.coalesce(b["below"], F.lit(0.0))
        inside = start + (b["bound"] - start) * F.try_divide(b["total"] * q - b["before"], b["cum"] - b["before"])
        return (
            F.when(b["bound"] == float("inf"), b["below"])
            .when(b["below"].isNull() & (b["bound"] <= 0), b["bound"])
            .otherwise(F.coalesce(inside, b["bound"]))
        )

    lines = F.array(*[
        F.struct(F.lit(name).alias("line"), F.col(f"__{name}").isNotNull().alias("held"), value(F.col(f"__{name}"), q).alias("value"))
        for name, q in shares.items()
    ])
    return holding.select(*keys, F.inline(lines)).where("held").drop("held")


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """One quantile, without its name."""
    return histogram_quantiles(buckets, {"q": q}, by).drop("line")


def topk_per_step(series: DataFrame, k: int, within: Sequence[str] = ()) -> DataFrame:
    """The k highest series of each step.  Spark limits groups before the shuffle, so a step of any size is fine."""
    ties = [c for c in series.columns if c not in ("t", "value", "labels", *within)]
    order = Window.partitionBy("t", *within).orderBy(F.desc("value"), *ties)
    return series.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def label_values(samples: DataFrame, metric: str, name: str) -> DataFrame:
    """Distinct values of a label."""
    found = samples.where(F.col("metric") == metric).select(label(name).alias("value"))
    return found.where(F.col("value").isNotNull()).distinct().orderBy("value")


def last_value(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Latest value that is there, per key: what a tile shows."""
    known = series.where(F.col("value").isNotNull())
    return known.groupBy(*by).agg(F.max_by("value", "t").alias("value"))


def threshold_state(df: DataFrame, steps: Sequence[tuple[float | None, str]]) -> DataFrame:
    """Colour of ``value``: the last step that it reaches; the first step has no bound."""
    state = F.lit(steps[0][1])
    for bound, colour in steps[1:]:
        state = F.when(F.col("value") >= bound, F.lit(colour)).otherwise(state)
    return df.withColumn("state", state)
