"""Panel families: each turns records (or dead letters) into one small result table.

Every family aggregates before anything is ordered, so a hot bucket is combined map-side and only one
row per bucket and task is shuffled.  Top-N is ``orderBy().limit()``, which Spark runs as a bounded
take per task.  Rankings use the metric rounded to six digits, then the bucket, because the last
digits of a distributed floating-point sum depend on task order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators.ranks import aggregate, metric, partial, whole
from loadlens.operators.series import ROWS, descending, record_parts, top_series

INDICATOR_NAMES = "stress_cost_indicator_names"


def with_bucket(df: DataFrame, dim: str, name: str = "bucket") -> DataFrame:
    """One row per bucket value; a record with k indicator names is in k buckets."""
    column = F.col(dim)
    if dim == INDICATOR_NAMES:
        column = F.explode(F.when(F.size(column) == 0, F.array(F.lit("unflagged"))).otherwise(column))
    return df.withColumn(name, column)


def label_of(dim: str, bucket: str = "bucket", chars: int | None = 60) -> Column:
    """What a chart prints for a bucket.

    Templates are cut to ``chars`` characters, so those that share a prefix merge; None keeps them whole.
    """
    text = F.col(bucket).cast("string")
    if dim == "request_template":
        return F.coalesce(F.nullif(text if chars is None else F.left(text, F.lit(chars)), F.lit("")), F.lit("(no template)"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(unknown)"))


def time_bin(ts: str = "timestamp", every: str = "1 hour") -> Column:
    return F.window(ts, every)["start"]


# Bin widths to choose from, in seconds.
_STEPS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)


def auto_interval(seconds: float, points: int = 1000) -> str:
    """Smallest step that shows a range of ``seconds`` in at most ``points`` bins."""
    for step in _STEPS:
        if seconds / step <= points:
            return f"{step} seconds"
    days = -(-seconds // (points * 86400))
    return f"{int(days) * 86400} seconds"


def with_time(df: DataFrame, every: str | None, ts: str = "timestamp", points: int = 1000) -> DataFrame:
    """``df`` with its time bin ``t``.  Without a width, it is the smallest step that shows the data's range in ``points`` bins.

    The range is a one-row aggregate inside the plan.
    """
    if every is not None:
        return df.withColumn("t", time_bin(ts, every))
    return _binned(df.withColumn("__second", _second(ts)), F.min(ts), F.max(ts), points)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _second(ts: str) -> Column:
    return F.timestamp_diff("SECOND", _epoch(), F.col(ts))


def _binned(df: DataFrame, first: Column, last: Column, points: int = 1000) -> DataFrame:
    """Rows with a ``__second`` in the bins that show the range from ``first`` to ``last``, aggregates over ``df``."""
    seconds = F.greatest(F.timestamp_diff("SECOND", first, last), F.lit(1))
    days = F.ceil(F.col("__seconds") / (points * 86400)) * 86400
    fits = F.filter(F.array(*[F.lit(x) for x in _STEPS]), lambda x: F.col("__seconds") / x <= points)
    span = df.agg(seconds.alias("__seconds")).select(F.coalesce(F.try_element_at(fits, F.lit(1)), days).cast("long").alias("__step"))
    place = F.floor(F.col("__second") / F.col("__step")) * F.col("__step")
    # One row by construction: an aggregate without grouping keys.
    return df.crossJoin(F.broadcast(span)).withColumn("t", F.timestamp_add("SECOND", place, _epoch())).drop("__step", "__second")


def _auto_parts(df: DataFrame, dim: str, op: str, column: str | None, ts: str = "timestamp") -> DataFrame:
    """Partial results in bins whose width follows from the data, from one look at ``df``.

    Rows are first reduced per second and series; the range and the bins are both read from that.
    """
    seconds = with_bucket(df, dim, "series").groupBy(_second(ts).alias("__second"), "series").agg(
        F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.count(F.lit(1)).alias(ROWS), *partial(op, column, "value"))
    return _binned(whole(seconds), F.min("__first"), F.max("__last")).drop("__first", "__last")


# -- single numbers and rankings ------------------------------------------------------------

def stat(df: DataFrame, op: str, column: str | None = None, where: str = "") -> DataFrame:
    """One number over everything that passes."""
    return aggregate(df.where(where) if where else df, [], {"value": (op, column)})


def pie(df: DataFrame, dim: str, n: int = 8, chars: int | None = 60) -> DataFrame:
    """Share of total stress by label."""
    return (
        with_bucket(df, dim).groupBy(label_of(dim, chars=chars).alias("label")).agg(F.sum("stress_score").alias("stress"))
        .orderBy(descending("stress"), "label").limit(n)
    )


def table(df: DataFrame, dim: str, metrics: dict[str, tuple], n: int = 10, rank_by: str | None = None) -> DataFrame:
    """Several metrics by bucket, the top N by the first one (or ``rank_by``)."""
    rank_by = rank_by or next(iter(metrics))
    return (
        aggregate(with_bucket(df, dim), ["bucket"], metrics).orderBy(descending(rank_by), "bucket").limit(n)
    )


def bar(df: DataFrame, dim: str, name: str, op: str, column: str | None = None, n: int = 10) -> DataFrame:
    return table(df, dim, {name: (op, column)}, n)


def stacked(df: DataFrame, dim: str, metrics: dict[str, tuple], n: int = 10) -> DataFrame:
    """Several metrics for the first N buckets by name."""
    return (
        aggregate(with_bucket(df, dim), ["bucket"], metrics).orderBy("bucket").limit(n)
    )


def document_id() -> Column:
    """Readable id of a request: time, operation, start of the path."""
    return F.concat_ws(
        "-", F.date_format("timestamp", "yyMMddHHmmss"), F.col("request_operation"), F.left("request_path", F.lit(20))
    )


def heaviest(df: DataFrame, columns: dict[str, str | Column], n: int = 50, by: str = "stress_score") -> DataFrame:
    """The N rows with the highest value of ``by``."""
    shown = []
    for name, column in columns.items():
        if isinstance(column, Column):
            shown.append(column.alias(name))
        elif column == "timestamp":
            shown.append(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias(name))
        elif column == INDICATOR_NAMES:
            shown.append(F.array_join(column, ", ").alias(name))
        else:
            shown.append(F.col(column).alias(name))
    ties = ("timestamp", "request_path", "msearch_sub_query_index", "identity_client_host")
    return df.orderBy(F.desc(by), *ties).limit(n).select(*shown)


# -- time series ----------------------------------------------------------------------------

def trend(
    df: DataFrame,
    dim: str | None,
    op: str = "avg",
    column: str | None = "stress_score",
    every: str | None = "1 hour",
    n: int | None = 5,
    rank_by: str = "count",
) -> DataFrame:
    """(t, series, value) for the N series with the most rows, or the highest metric, in one pass over ``df``.

    Percentiles cannot be merged from bins; they take a second pass over the series that were chosen.
    """
    if every is None and dim is not None and not op.startswith("percentile_"):
        return top_series(_auto_parts(df, dim, op, column), op, n, rank_by)
    rows = with_time(df, every)
    if dim is None:
        return aggregate(rows, ["t"], {"value": (op, column)}).orderBy("t")
    rows = with_bucket(rows, dim, "series")
    if not op.startswith("percentile_"):
        return top_series(record_parts(rows, op, column), op, n, rank_by)
    if n is not None:
        top = rows.groupBy("series").agg(F.count(F.lit(1)).alias("__rank")).orderBy(descending("__rank"), "series").limit(n)
        rows = rows.join(F.broadcast(top.select(F.col("series").alias("__s"))), F.col("series").eqNullSafe(F.col("__s")), "left_semi")
    return aggregate(rows, ["t", "series"], {"value": (op, column)}).orderBy("t", "series")


def trend_multi(df: DataFrame, metrics: dict[str, tuple], every: str | None = "1 hour") -> DataFrame:
    """Wide (t, metric...).  A metric is (op, column) or (op, column, predicate); a predicate limits its metric only."""
    out = {}
    for name, (op, column, *predicate) in metrics.items():
        if predicate:
            held, passes = f"__{name}", F.expr(predicate[0])
            one = F.when(passes, 1).otherwise(0) if op == "count" else F.when(passes, F.col(column))
            df, op, column = df.withColumn(held, one), "sum" if op == "count" else op, held
        out[name] = (op, column)
    return aggregate(with_time(df, every), ["t"], out).orderBy("t")


def trend_pairs(df: DataFrame, first: str, second: str, every: str | None = "1 hour", n: int | None = 10) -> DataFrame:
    """Request count of the N most frequent 'first/second' combinations."""
    pair = F.concat_ws("/", F.col(first), F.col(second).cast("string"))
    return trend(df.withColumn("__pair", pair), "__pair", "count", None, every, n)


def wide(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long (t, series, value) to one column per named series."""
    return series.groupBy("t").pivot("series", list(names)).agg(F.first("value")).orderBy("t")


# -- variables and dead letters -------------------------------------------------------------

def variable_values(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Distinct values to offer for a filter, the first N of them or all."""
    values = with_bucket(df, column, "value").select("value").distinct().orderBy("value")
    return values if n is None else values.limit(n)


def dlq_count(dead: DataFrame, every: str = "1 hour") -> DataFrame:
    return (
        dead.groupBy(time_bin(every=every).alias("t"), "cluster_name").agg(F.count(F.lit(1)).alias("dlq_docs"))
        .orderBy("t", "cluster_name")
    )


def dlq_recent(dead: DataFrame, n: int = 20) -> DataFrame:
    return (
        dead.orderBy(F.desc("timestamp"), "request_path", "error").limit(n)
        .select(F.col("timestamp").alias("time"), "error", F.col("request_path").alias("path"), F.col("request_method").alias("method"))
    )


# -- kinds ----------------------------------------------------------------------------------

def operation_kind() -> Column:
    """insert, update, delete or query."""
    op = F.col("request_operation")
    return (
        F.when(op.isin("_bulk", "_create", "index"), "insert")
        .when(op.isin("_update", "_update_by_query"), "update")
        .when(op.isin("delete", "_delete_by_query"), "delete")
        .otherwise("query")
    )


def query_type() -> Column:
    """Most expensive kind of clause in a query: agg, knn, geo, text or simple; '' for writes."""
    clause = {name: F.col(f"clause_counts_{name}") for name in (
        "agg", "knn", "geo_distance", "geo_shape", "geo_bbox", "wildcard", "fuzzy", "bool", "nested")}
    return (
        F.when(operation_kind() != "query", "")
        .when(clause["agg"] > 0, "agg")
        .when(clause["knn"] > 0, "knn")
        .when(clause["geo_distance"] + clause["geo_shape"] + clause["geo_bbox"] > 0, "geo")
        .when(clause["wildcard"] + clause["fuzzy"] + clause["bool"] + clause["nested"] > 0, "text")
        .otherwise("simple")
    )
