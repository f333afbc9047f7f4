"""Every dashboard panel by name: a family plus its arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from loadlens.operators.series import record_parts, routed, summary_parts
from loadlens.operators.summary import can_answer, summary_trend
from loadlens.plans import panels as P
from loadlens.plans.filters import DIMENSIONS, Filters

APPLICATION = "identity_applicative_provider"
TARGET = "request_target"
OPERATION = "request_operation"
TEMPLATE = "request_template"
INDICATOR = P.INDICATOR_NAMES
TOOK = "response_es_took_ms"

LATENCY = {"avg": ("avg", TOOK), "p50": ("percentile_50", TOOK), "p95": ("percentile_95", TOOK), "p99": ("percentile_99", TOOK)}
_P50_P99 = {f"{p}_took": spec for p, spec in LATENCY.items() if p != "avg"}

_TOP_TEMPLATES = {
    "sum_stress": ("sum", "stress_score"), "avg_stress": ("avg", "stress_score"), **_P50_P99,
    "avg_indicators": ("avg", "stress_cost_indicator_count"), "requests": ("count",),
}
_TOP_INDICATORS = {"sum_stress": ("sum", "stress_score"), "avg_stress": ("avg", "stress_score"), **_P50_P99, "requests": ("count",)}
_COMPONENTS = {name: ("avg", f"stress_components_{name}") for name in ("took", "shards", "hits", "bonus")}
_BREAKDOWN = {
    "requests": ("count",), "avg_score": ("avg", "stress_score"), "multiplier": ("avg", "stress_multiplier"),
    "took_weighted": ("avg", "stress_components_took"), **_P50_P99,
    "shards_weighted": ("avg", "stress_components_shards"), "shards_raw": ("avg", "response_shards_total"),
    "hits_weighted": ("avg", "stress_components_hits"), "hits_raw": ("avg", "response_hits"),
    "bonus": ("avg", "stress_components_bonus"),
}
_BASE_VS_FINAL = {
    "requests": ("count",), "avg_base": ("avg", "stress_base"), "avg_multiplier": ("avg", "stress_multiplier"),
    "avg_final": ("avg", "stress_score"), "avg_indicators": ("avg", "stress_cost_indicator_count"),
}
_BY_INDICATORS = {
    "avg_indicators": ("avg", "stress_cost_indicator_count"), "avg_multiplier": ("avg", "stress_multiplier"),
    "avg_stress": ("avg", "stress_score"), "requests": ("count",),
}
_HEAVIEST = {
    "doc_id": None, "time": "timestamp", "request_body": "request_body", "operation": OPERATION, "target": TARGET,
    "path": "request_path", "stress": "stress_score", "es_latency_ms": TOOK, "cost_indicators": INDICATOR,
}


def _averages(prefix: str, names) -> dict[str, tuple]:
    return {f"avg_{name}": ("avg", f"{prefix}{name}") for name in names}


def _heaviest(df: DataFrame) -> DataFrame:
    return P.heaviest(df, {**_HEAVIEST, "doc_id": P.document_id()}, 50)


Panel = Callable[..., DataFrame]


def _panel(family: Callable[..., DataFrame], *args, **kwargs) -> Panel:
    """A family with its arguments; a call may change the family's own ``n``, ``every`` and ``chars``."""
    bound = inspect.signature(family).bind_partial(None, *args, **kwargs).arguments
    frame = next(iter(bound))

    def panel(df: DataFrame, **options) -> DataFrame:
        unknown = set(options) - (set(inspect.signature(family).parameters) & set(OPTIONS))
        if unknown:
            raise ValueError(f"{family.__name__} has no such option: {sorted(unknown)}")
        return family(**{**bound, **options, frame: df})

    return panel


OPTIONS = ("n", "every", "chars")

# Panels over records.
RECORD_PANELS: dict[str, Panel] = {
    "total_stress": _panel(P.stat, "sum", "stress_score"),
    "pie_application": _panel(P.pie, APPLICATION, 8),
    "pie_target": _panel(P.pie, TARGET, 8),
    "pie_operation": _panel(P.pie, OPERATION, 8),
    "pie_cost_indicator": _panel(P.pie, INDICATOR, 10),
    "pie_template": _panel(P.pie, TEMPLATE, 10),
    "top_templates": _panel(P.table, TEMPLATE, _TOP_TEMPLATES, 10),
    "heaviest_operations": _heaviest,
    "top_cost_indicators": _panel(P.table, INDICATOR, _TOP_INDICATORS, 10),
    "trend_application": _panel(P.trend, APPLICATION, n=5),
    "trend_target": _panel(P.trend, TARGET, n=5),
    "trend_operation": _panel(P.trend, OPERATION, n=5),
    "trend_cost_indicator": _panel(P.trend, INDICATOR, n=5),
    "trend_template": _panel(P.trend, TEMPLATE, n=10),
    "docs_matched_sum": _panel(P.trend, None, "sum", "response_hits"),
    "docs_matched_avg": _panel(P.trend, None, "avg", "response_hits"),
    "bulk_write_sum": _panel(P.trend, None, "sum", "request_bulk_doc_count"),
    "bulk_write_avg": _panel(P.trend, None, "avg", "request_bulk_doc_count"),
    "request_size_sum": _panel(P.trend, None, "sum", "request_size_bytes"),
    "request_size_avg": _panel(P.trend, None, "avg", "request_size_bytes"),
    "es_latency": _panel(P.trend_multi, LATENCY),
    "status_by_operation": _panel(P.trend_pairs, OPERATION, "response_status", n=10),
    "flagged_requests": _panel(P.stat, "count", None, "stress_cost_indicator_count >= 1"),
    "avg_indicator_count": _panel(P.stat, "avg", "stress_cost_indicator_count"),
    "avg_multiplier": _panel(P.stat, "avg", "stress_multiplier"),
    "max_multiplier": _panel(P.stat, "max", "stress_multiplier"),
    "score_composition": _panel(P.stacked, TEMPLATE, _COMPONENTS, 10),
    "base_vs_final": _panel(P.table, TEMPLATE, _BASE_VS_FINAL, 10),
    "templates_by_indicator_count": _panel(P.table, TEMPLATE, _BY_INDICATORS, 10),
    "score_breakdown": _panel(P.table, TEMPLATE, _BREAKDOWN, 10),
    "score_components_trend": _panel(P.trend_multi, _averages("stress_components_", ("took", "shards", "hits", "bonus"))),
    "base_trend_template": _panel(P.trend, TEMPLATE, "avg", "stress_base", n=10),
    "multiplier_trend_template": _panel(P.trend, TEMPLATE, "avg", "stress_multiplier", n=10),
    "indicators_trend_application": _panel(P.trend, APPLICATION, "avg", "stress_cost_indicator_count", n=8),
    "flagged_vs_total": _panel(
        P.trend_multi, {"flagged": ("count", None, "stress_cost_indicator_count >= 1"), "total": ("count", None)}),
    "indicator_frequency": _panel(P.bar, INDICATOR, "count", "count"),
    "multiplier_by_application": _panel(P.bar, APPLICATION, "avg_multiplier", "avg", "stress_multiplier", 8),
    "indicators_by_target": _panel(P.bar, TARGET, "avg_indicators", "avg", "stress_cost_indicator_count", 8),
    "multiplier_by_target": _panel(P.bar, TARGET, "avg_multiplier", "avg", "stress_multiplier", 8),
    "clause_trends": _panel(P.trend_multi, _averages("clause_counts_", ("terms_values", "agg", "script", "wildcard"))),
    "bool_breakdown_trend": _panel(
        P.trend_multi, _averages("clause_counts_", ("bool_must", "bool_should", "bool_filter", "bool_must_not"))),
    "total_rate": _panel(P.trend_multi, {"requests": ("count", None)}),
    "error_rate": _panel(P.trend_multi, {"errors": ("count", None, "response_status >= 400"), "total": ("count", None)}),
    "by_status": _panel(P.table, "response_status", {"requests": ("count",)}, 10),
    "by_application": _panel(P.table, APPLICATION, {"requests": ("count",), **_P50_P99}, 10),
    "read_volume_by_op": _panel(P.trend, OPERATION, "sum", "response_hits", n=8),
    "bulk_volume_by_op": _panel(P.trend, OPERATION, "sum", "request_bulk_doc_count", n=8),
    "payload_sizes": _panel(
        P.trend_multi, {"avg_request": ("avg", "request_size_bytes"), "avg_response": ("avg", "response_size_bytes")}),
    "top_applications": _panel(P.bar, APPLICATION, "requests", "count"),
    "top_indices": _panel(P.bar, TARGET, "requests", "count"),
    "top_users": _panel(P.bar, "identity_username", "requests", "count"),
    "operation_kind": lambda r: P.table(
        r.withColumn("kind", P.operation_kind()), "kind", {"sum_stress": ("sum", "stress_score"), "requests": ("count",)}),
    "query_type": lambda r: P.table(
        r.withColumn("kind", P.query_type()).where("kind <> ''"), "kind",
        {"sum_stress": ("sum", "stress_score"), "requests": ("count",)}),
}

# Panels that continue on the summary after raw rows have expired: dimension (None = total), N.
DUAL_PANELS: dict[str, tuple[str | None, int]] = {
    "request_volume": (None, 5),
    "rate_by_operation": (OPERATION, 8),
    "rate_by_application": (APPLICATION, 8),
    "rate_by_target": (TARGET, 8),
    "rate_by_template": (TEMPLATE, 8),
}

# Panels over dead letters.
DEAD_LETTER_PANELS: dict[str, Panel] = {
    "dlq_count": lambda d: P.dlq_count(d),
    "dlq_recent": lambda d: P.dlq_recent(d, 20),
}

VARIABLE_LIMITS = {"summary": 1000, "raw": 500}


def dual(records: DataFrame, summary: DataFrame, name: str) -> DataFrame:
    """(source, t, series, value): the raw series and the one from the hourly summary."""
    dim, n = DUAL_PANELS[name]
    raw = P.trend(records, dim, "count", None, "1 hour", n)
    rolled = summary_trend(summary, dim, "count", None, n)
    if dim is None:
        raw, rolled = (df.withColumn("series", F.lit("count")) for df in (raw, rolled))
    columns = ["source", "t", "series", "value"]
    return raw.withColumn("source", F.lit("raw")).select(*columns).unionByName(
        rolled.withColumn("source", F.lit("summary")).select(*columns)
    )


def variable(
    records: DataFrame, summary: DataFrame, name: str, now: datetime | None = None,
    limits: dict[str, int | None] = VARIABLE_LIMITS, days: int = 7,
) -> DataFrame:
    """Values of a dashboard variable: from the summary where it has the column, else from raw rows of the last ``days``.

    ``limits`` caps the values per source; None offers all.
    """
    column = DIMENSIONS[name]
    if column in summary.columns:
        return P.variable_values(summary, column, limits["summary"])
    moment = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    recent = records.where(F.col("timestamp") > moment - F.make_dt_interval(F.lit(days)))
    if now and "day" in records.columns:
        recent = recent.where(F.col("day") >= F.lit((now - timedelta(days=days)).date()))
    return P.variable_values(recent, column, limits["raw"])


def pick_source(filters: Filters, dims: list[str], op: str, column: str | None, now: datetime, raw_days: int = 3) -> str:
    """'summary' when the range starts before raw rows expire and the summary can answer, else 'raw'."""
    reaches_back = filters.start is None or filters.start < now - timedelta(days=raw_days)
    answers = can_answer(op, column, dims) and not filters.needs_raw()
    return "summary" if reaches_back and answers else "raw"


def raw_since(now: datetime, raw_days: int = 3) -> datetime:
    """The first whole hour that raw rows still hold in full."""
    border = now - timedelta(days=raw_days)
    hour = border.replace(minute=0, second=0, microsecond=0)
    return hour if hour == border else hour + timedelta(hours=1)


def routed_trend(
    records: DataFrame, summary: DataFrame, dim: str | None, op: str = "count", column: str | None = None,
    filters: Filters = Filters(), now: datetime | None = None, n: int | None = 5, raw_days: int = 3,
) -> DataFrame:
    """Hourly (t, series, value) over any range: raw rows from ``raw_since`` on, the summary before, no hour from both.

    The summary answers whole hours, so a range that starts within one of its hours gets that hour whole.  Series are
    ranked over both halves together.  What the summary cannot answer comes from raw rows alone.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    source = pick_source(filters, [] if dim is None else [dim], op, column, now, raw_days)
    if op not in ("count", "sum", "avg"):
        source = "raw"
    border = raw_since(now, raw_days)
    rows = P.with_time(filters.apply(records), "1 hour")
    rows = P.with_bucket(rows, dim, "series") if dim else rows.withColumn("series", F.lit(None).cast("string"))
    if source == "raw":
        out = P.trend(filters.apply(records), dim, op, column, "1 hour", n)
        return out if dim else out.select("t", F.lit(None).cast("string").alias("series"), "value")
    early = replace(
        filters, start=filters.start and filters.start.replace(minute=0, second=0, microsecond=0),
        end=min(filters.end, border) if filters.end else border)
    recent = record_parts(rows.where(F.col("timestamp") >= F.lit(border).cast("timestamp_ntz")), op, column)
    return routed(recent, summary_parts(early.apply(summary, "time_bucket"), dim, op, column), op, n)


def run_panel(
    name: str, records: DataFrame, filters: Filters | None = None, summary: DataFrame | None = None,
    now: datetime | None = None, **options,
) -> DataFrame:
    """A panel by name.  Panels that continue beyond raw retention read ``summary`` for what lies before it.

    ``options``: ``n`` (series or rows), ``every`` (bin width, None: from the data's range) and ``chars`` (length of
    template labels, None: whole), for panels whose family has them.
    """
    filters = filters or Filters()
    if name in DUAL_PANELS:
        dim, n = DUAL_PANELS[name]
        if summary is not None:
            return routed_trend(records, summary, dim, "count", None, filters, now, options.get("n", n))
        return P.trend(filters.apply(records), dim, "count", None, options.get("every", "1 hour"), options.get("n", n))
    return RECORD_PANELS[name](filters.apply(records), **options)
