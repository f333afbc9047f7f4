"""Top-N time series in one pass, over records, summary states, or both.

Input is reduced once to one row per time bin and series.  Those rows are folded into one row per series with its bins, so
ranking and selecting series needs no second look at the input: the best N rows are taken and opened again.  A series holds
at most one entry per time bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.ranks import merged, partial
from loadlens.schema import AVG_STATES, SUM_STATES

_RANK_DIGITS = 6
ROWS = "__rows"


def descending(name: str) -> Column:
    return F.round(F.col(name).cast("double"), _RANK_DIGITS).desc()


def record_parts(df: DataFrame, op: str, column: str | None) -> DataFrame:
    """(t, series, partial results) of records that carry ``t`` and ``series``."""
    return df.groupBy("t", "series").agg(F.count(F.lit(1)).alias(ROWS), *partial(op, column, "value"))


def summary_parts(summary: DataFrame, dim: str | None, op: str, column: str | None) -> DataFrame:
    """The same from hourly states."""
    rows = summary.select(
        F.col("time_bucket").alias("t"), (F.lit(None).cast("string") if dim is None else F.col(dim)).alias("series"), "*")
    if op == "count":
        parts = [F.sum("count_state").alias("value__count")]
    elif op == "sum":
        state = {c: s for s, c in SUM_STATES.items()}[column]
        parts = [F.sum(state).alias("value__sum")]
    else:
        state = {c: s for s, c in AVG_STATES.items()}[column]
        parts = [F.sum(F.col(state)["sum"]).alias("value__sum"), F.sum(F.col(state)["n"]).alias("value__n")]
    return rows.groupBy("t", "series").agg(F.sum("count_state").alias(ROWS), *parts)


def top_series(parts: DataFrame, op: str, n: int | None, rank_by: str = "count") -> DataFrame:
    """(t, series, value) of the N series with the most rows, or the highest metric; all series where ``n`` is None."""
    bins = parts.groupBy("t", "series").agg(F.sum(ROWS).alias(ROWS), *_again(parts))
    value = F.col("value__sum") / F.col("value__n") if op == "avg" else F.col(f"value__{op}")
    rank = F.sum(ROWS) if rank_by == "count" else merged(op, "value")
    folded = bins.groupBy("series").agg(rank.alias("__rank"), F.collect_list(F.struct("t", value.alias("value"))).alias("__bins"))
    if n is not None:
        folded = folded.orderBy(descending("__rank"), "series").limit(n)
    return folded.select("series", F.inline("__bins")).select("t", "series", "value").orderBy("t", "series")


def _again(parts: DataFrame) -> list[Column]:
    """Partial results of one bin from two sources add up."""
    how = {"max": F.max, "min": F.min}
    return [how.get(c.split("__")[1], F.sum)(c).alias(c) for c in parts.columns if c.startswith("value__")]


def routed(raw: DataFrame, summary: DataFrame, op: str, n: int | None) -> DataFrame:
    """Parts of the raw hours and of the summary's hours, ranked together."""
    return top_series(raw.unionByName(summary), op, n)
