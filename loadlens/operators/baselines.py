"""Median baselines: what "normal" latency and shard fan-out were in the hour before.

``trailing_baselines`` gives one row for one moment; ``asof_baselines`` one row per minute, so that a
backfill scores each request against the hour before it instead of the hour before the job ran.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.ranks import aggregate, weighted_percentiles

# Traffic the medians are taken over, and the measures they replace.
BASELINE_OPERATIONS = ("_search", "_msearch", "_count")
_MEASURES = {"took_ms": "response_es_took_ms", "shards_total": "response_shards_total"}


def _usable(value: Column) -> Column:
    return F.when((value > 0) & ~F.isnan(value), value)


def trailing_baselines(records: DataFrame, at: datetime | Column, window: str = "1 hour") -> DataFrame:
    """One row: the medians over ``[at - window, at)``, NULL where there is no usable one."""
    moment = at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
    recent = records.where(
        (F.col("timestamp") >= moment - F.expr(f"INTERVAL {window}"))
        & (F.col("timestamp") < moment)
        & F.col("request_operation").isin(*BASELINE_OPERATIONS)
    )
    medians = aggregate(recent, [], {name: ("percentile_50", column) for name, column in _MEASURES.items()})
    return medians.select(*[_usable(F.col(name)).alias(f"baseline_{name}") for name in _MEASURES])


def minute_of(ts: Column) -> Column:
    return F.window(ts, "1 minute")["start"]


#: Ticks (about 40 bytes each) that may be broadcast: almost two years of minutes.
BROADCAST_TICKS = 1_000_000


def asof_baselines(
    records: DataFrame, minutes: int = 60, exact: bool = True, broadcast_ticks: int = BROADCAST_TICKS,
) -> DataFrame:
    """One row per minute tick that follows traffic: medians over the ``minutes`` before the tick.

    There are at most as many ticks as minutes in the range of the records and ``minutes`` more.  That range is looked up
    (one column of the input), and where it bounds the ticks by ``broadcast_ticks`` they are marked for a broadcast, so
    that scoring moves no record.  Beyond it the join is left to the optimizer.

    Rows are first reduced to one state per minute - value frequencies, or a KLL sketch when
    ``exact`` is false - and only the states are copied to the ticks that see them, so the copying
    grows with minutes, not with requests.
    """
    queries = records.where(F.col("request_operation").isin(*BASELINE_OPERATIONS)).select(
        minute_of(F.col("timestamp")).alias("minute"),
        *[F.col(column).cast("double").alias(name) for name, column in _MEASURES.items()],
    )
    ticks = F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(minutes)), lambda n: F.timestamp_add("MINUTE", n, F.col("minute"))
    )).alias("tick")
    ends = queries.agg(F.min("minute").alias("first"), F.max("minute").alias("last")).first()
    few = ends["first"] is None or (ends["last"] - ends["first"]).total_seconds() / 60 + minutes <= broadcast_ticks
    marked = F.broadcast if few else lambda df: df
    if not exact:
        states = queries.groupBy("minute").agg(
            *[F.kll_sketch_agg_double(F.col(name)).alias(name) for name in _MEASURES]
        )
        return marked(states.select(ticks, *_MEASURES).groupBy("tick").agg(*[
            _usable(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(name), F.lit(0.5))).alias(f"baseline_{name}")
            for name in _MEASURES
        ]))
    measure = F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in _MEASURES
    ]))
    frequencies = queries.select("minute", measure).groupBy("minute", "name", "value").agg(F.count("*").alias("n"))
    spread = frequencies.select(ticks, "name", "value", "n").groupBy("tick", "name", "value").agg(F.sum("n").alias("n"))
    medians = weighted_percentiles(spread, ["tick", "name"], "value", "n", {"median": 0.5})
    return marked(medians.groupBy("tick").agg(*[
        _usable(F.max(F.when(F.col("name") == name, F.col("median")))).alias(f"baseline_{name}") for name in _MEASURES
    ]))


def join_baselines(df: DataFrame, baselines: DataFrame | None) -> DataFrame:
    """Attach ``baseline_*`` columns to rows with a ``timestamp``."""
    if baselines is None:
        return df
    if "tick" not in baselines.columns:
        # One row by construction: an aggregate without grouping keys.
        return df.crossJoin(F.broadcast(baselines))
    # One row per minute, marked for a broadcast where its size is known to be small; else AQE splits a hot minute.
    return df.withColumn("tick", minute_of(F.col("timestamp"))).join(baselines, "tick", "left").drop("tick")
