"""Hourly roll-up as mergeable states.

A batch appends its partial states; reading merges them.  Sums and counts add up, means are kept as
(sum, n), percentiles as KLL sketches, so any number of partial rows for one key gives the same
answer as one row, late data included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.series import descending, summary_parts, top_series
from loadlens.schema import AVG_STATES, PCT_STATES, SUM_STATES, SUMMARY, SUMMARY_DIMS

# Percentiles a sketch is read at.
PERCENTILES = (0.5, 0.95, 0.99)

# (op, record column) -> state that answers it.
STATE_OF = {("count", None): "count_state"}
STATE_OF.update({("sum", column): state for state, column in SUM_STATES.items()})
STATE_OF.update({("avg", column): state for state, column in AVG_STATES.items()})
_SKETCHES = {column: state for state, column in PCT_STATES.items()}


def summary_states(records: DataFrame) -> DataFrame:
    """Partial states of one batch of records, per hour and dimensions."""
    hour = F.window("timestamp", "1 hour")["start"]
    return (
        records.where(F.col("request_operation") != "unknown")
        .groupBy(hour.alias("time_bucket"), *SUMMARY_DIMS[1:])
        .agg(
            F.count(F.lit(1)).alias("count_state"),
            *[F.sum(F.col(c).cast("double")).alias(s) for s, c in SUM_STATES.items()],
            *[
                F.struct(F.sum(F.col(c).cast("double")).alias("sum"), F.count(c).alias("n")).alias(s)
                for s, c in AVG_STATES.items()
            ],
            *[F.kll_sketch_agg_double(F.col(c).cast("double")).alias(s) for s, c in PCT_STATES.items()],
        )
    )


def _merged(state: str) -> Column:
    if state == "count_state" or state in SUM_STATES:
        return F.sum(state)
    if state in AVG_STATES:
        return F.struct(F.sum(F.col(state)["sum"]).alias("sum"), F.sum(F.col(state)["n"]).alias("n"))
    return F.kll_merge_agg_double(state)


_STATES = tuple(SUMMARY.names[len(SUMMARY_DIMS):])


def merge_states(summary: DataFrame, keys=SUMMARY_DIMS, states=_STATES) -> DataFrame:
    """States merged over ``keys``: fewer keys, or a coarser time column, give a coarser summary."""
    return summary.groupBy(*keys).agg(*[_merged(state).alias(state) for state in states])


def merge_daily(summary: DataFrame, keys=SUMMARY_DIMS[1:]) -> DataFrame:
    """States by day and ``keys``."""
    day = summary.withColumn("time_bucket", F.window("time_bucket", "1 day")["start"])
    return merge_states(day, ("time_bucket", *keys))


def finalised(op: str, column: str | None) -> Column:
    """Aggregate over state rows that equals ``op(column)`` over the records behind them."""
    if op.startswith("percentile_"):
        if column not in _SKETCHES:
            raise ValueError(f"the summary keeps no percentiles of {column}")
        share = int(op.split("_", 1)[1]) / 100
        return F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(_SKETCHES[column]), F.lit(share))
    state = STATE_OF.get((op, column if op != "count" else None))
    if state is None:
        raise ValueError(f"the summary cannot answer {op}({column})")
    if op == "avg":
        return F.sum(F.col(state)["sum"]) / F.sum(F.col(state)["n"])
    return F.sum(state)


def finalize_states(summary: DataFrame, keys=SUMMARY_DIMS) -> DataFrame:
    """Readable numbers: count, sums, means and percentiles per ``keys``."""
    numbers = [F.sum("count_state").alias("count")]
    numbers += [finalised("sum", c).alias(s.removesuffix("_state")) for s, c in SUM_STATES.items()]
    numbers += [finalised("avg", c).alias(s.removesuffix("_state")) for s, c in AVG_STATES.items()]
    numbers += [
        finalised(f"percentile_{round(p * 100)}", c).alias(f"{s.removesuffix('_state')}_p{round(p * 100)}")
        for s, c in PCT_STATES.items() for p in PERCENTILES
    ]
    return summary.groupBy(*keys).agg(*numbers)


def summary_trend(
    summary: DataFrame, dim: str | None, op: str = "avg", column: str | None = "stress_score", n: int = 5
) -> DataFrame:
    """Hourly (t, series, value) from states; series are ranked by the metric itself."""
    value, t = finalised(op, column), F.col("time_bucket").alias("t")
    if dim is None:
        return summary.groupBy(t).agg(value.alias("value")).orderBy("t")
    if not op.startswith("percentile_"):
        return top_series(summary_parts(summary, dim, op, column), op, n, "metric")
    rows = summary.withColumn("series", F.col(dim))
    top = rows.groupBy("series").agg(value.alias("__rank")).orderBy(descending("__rank"), "series").limit(n)
    return (
        rows.join(F.broadcast(top), "series", "left_semi").groupBy(t, "series").agg(value.alias("value"))
        .orderBy("t", "series")
    )


def can_answer(op: str, column: str | None, dims=()) -> bool:
    """Whether the summary holds what a metric over these record columns needs."""
    known = (op, column if op != "count" else None) in STATE_OF or (
        op.startswith("percentile_") and column in _SKETCHES
    )
    return known and set(dims) <= set(SUMMARY_DIMS)
