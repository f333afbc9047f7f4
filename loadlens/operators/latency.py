"""Latency reports over ``samples(ts, path_name, workers, op, latency_ms, status, body)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.ranks import aggregate

# Acceptance limits.
MAX_P50_OVERHEAD = 15.0
MAX_P95_OVERHEAD = 25.0
MAX_SCALING_RATIO = 2.0
PERCENTILES = (50, 95, 99)
SNIPPET = 512


def failed() -> Column:
    return (F.col("status") == 0) | (F.col("status") >= 400)


_PERCENTILES = {f"p{p}": (f"percentile_{p}", "latency_ms") for p in PERCENTILES}


def _or_zero(*names: str) -> list[Column]:
    return [F.coalesce(name, F.lit(0.0)).alias(name) for name in names]


def latency_report(samples: DataFrame) -> DataFrame:
    """Per operation and in total: count, errors, percentiles, maximum and rate over the elapsed time; 0 for no values.

    A sample counts for its operation and for the total, in one pass.
    """
    each = F.explode(F.array(F.struct(F.col("op").alias("op"), F.lit(False).alias("total")),
                             F.struct(F.lit(None).cast("string").alias("op"), F.lit(True).alias("total"))))
    rows = samples.select(each.alias("g"), failed().cast("int").alias("failed"), "latency_ms", "ts").select("g.*", "failed", "latency_ms", "ts")
    report = aggregate(rows, ["op", "total"], {
        "count": ("count",), "errors": ("sum", "failed"), **_PERCENTILES, "max": ("max", "latency_ms"),
        "first": ("min", "ts"), "last": ("max", "ts")})
    span = F.timestamp_diff("MICROSECOND", F.col("first"), F.col("last")) / 1e6
    return report.select(
        F.when(F.col("total"), F.lit("TOTAL")).otherwise(F.col("op")).alias("op"), "count",
        F.coalesce("errors", F.lit(0)).alias("errors"), *_or_zero(*_PERCENTILES, "max"),
        (F.col("count") / F.greatest(span, F.lit(0.01))).alias("rate"))


def error_samples(samples: DataFrame, n: int = 10, snippet: int = SNIPPET) -> DataFrame:
    """The first n failures, bodies cut to ``snippet`` characters."""
    return (
        samples.where(failed()).orderBy("ts", "op", "path_name").limit(n)
        .select("op", "status", F.left("body", F.lit(snippet)).alias("body"))
    )


def _percentiles_by(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentiles of successful requests."""
    return aggregate(samples.where(~failed()), keys, _PERCENTILES).select(*keys, *_or_zero(*_PERCENTILES))


def _overhead(slow: Column, base: Column) -> Column:
    return F.when(base > 0, (slow - base) / base * 100).otherwise(F.lit(0.0))


def compare_paths(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("op",)) -> DataFrame:
    """Overhead of path ``a`` over path ``b`` in percent, and whether it is within limits."""
    left, right = _percentiles_by(a, keys), _percentiles_by(b, keys)
    for p in PERCENTILES:
        left = left.withColumnRenamed(f"p{p}", f"a_p{p}")
        right = right.withColumnRenamed(f"p{p}", f"b_p{p}")
    both = left.join(right, list(keys)).select(
        *keys, *[f"{side}_p{p}" for side in "ab" for p in PERCENTILES],
        *[_overhead(F.col(f"a_p{p}"), F.col(f"b_p{p}")).alias(f"overhead_p{p}") for p in PERCENTILES],
    )
    passed = (F.col("overhead_p50") <= MAX_P50_OVERHEAD) & (F.col("overhead_p95") <= MAX_P95_OVERHEAD)
    return both.withColumn("passed", passed)


def scaling_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """How the p50 overhead at the most workers relates to that at the fewest."""
    ends = compare_paths(a, b, ("workers",)).agg(
        F.min_by("overhead_p50", "workers").alias("fewest"),
        F.max_by("overhead_p50", "workers").alias("most"),
        F.count(F.lit(1)).alias("rounds"),
    )
    known = (F.col("rounds") >= 2) & (F.col("fewest") != 0)
    ratio = F.when(known, F.abs("most") / F.greatest(F.abs("fewest"), F.lit(0.1)))
    return ends.select("fewest", "most", "rounds", ratio.alias("ratio")).withColumn(
        "passed", F.coalesce(F.col("ratio") < MAX_SCALING_RATIO, F.lit(True))
    )


def integrity(written: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Of the rows written: how many were found, how many differ in some field, how many rows there are."""
    fields = [c for c in written.columns if c != key]
    w = written.select(key, F.struct(*fields).alias("sent"))
    r = read.select(key, F.struct(*fields).alias("got"))
    both = w.join(r, key, "full_outer")
    found = F.col("sent").isNotNull() & F.col("got").isNotNull()
    return both.agg(
        F.count_if(F.col("sent").isNotNull()).alias("written"),
        F.count_if(found).alias("found"),
        F.count_if(found & ~F.equal_null("sent", "got")).alias("mismatches"),
        F.count_if(F.col("got").isNotNull()).alias("total"),
    ).withColumn(
        "passed",
        (F.col("found") == F.col("written")) & (F.col("mismatches") == 0) & (F.col("total") == F.col("written")),
    )


def _paths(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(samples.where(F.col("path_name") == name) for name in ("gateway", "direct"))


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "latency_report": latency_report,
    "latency_errors": error_samples,
    "latency_overhead": lambda s: compare_paths(*_paths(s)),
    "latency_scaling": lambda s: scaling_ratio(*_paths(s)),
}
