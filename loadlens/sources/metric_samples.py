"""Metric samples derived from the ``events`` table: each event is one scrape of one job.

Counters follow the event number and restart every 2000 events, so resets are part of the data.
Like the request log, the derivation is portable SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.plans import health as H

LABELS = ("cluster", "instance", "job", "reason", "status", "handler", "le", "plugin", "type", "gc")

BASE = {
    "ts": "ts",
    "n": "event_id % 2000",
    "c": "CAST(round(value * 100) AS BIGINT)",
    "grp": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    "cluster": "CASE user_id % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE 'default' END",
    "instance": "'i-' || CAST(user_id % 4 AS STRING)",
}
JOBS = ("logstash", "logstash", "gateway", "analyzer", "elasticsearch")


def _scrapes() -> list[tuple[int, str, dict[str, str], str]]:
    """(group, metric, extra labels, value as SQL over ``n``, ``c`` and ``k``)."""
    rows: list[tuple[int, str, dict[str, str], str]] = []

    def add(group: int, metric: str, value: str, **labels: str) -> None:
        rows.append((group, metric, labels, value))

    for step, metric in enumerate(H.FLOWS):
        add(0, metric, f"c % {400 - 10 * step}")
    add(0, H.UTILISATION, "c % 101")
    add(0, H.HEAP_PERCENT, "c % 97")
    add(0, H.BACKPRESSURE, "c % 13")
    add(0, H.QUEUE, "c % 5000")
    add(0, H.FD_OPEN, "c % 900")
    add(0, H.FD_MAX, "1024")
    add(0, H.PIPELINE_UP, "CASE WHEN c % 10 = 0 THEN 0 ELSE 1 END")
    add(0, H.PIPELINE_CPU, "c % 89")
    for step, metric in enumerate(H.PIPELINE_HEAP):
        add(0, metric, f"{1 + step} * 1000 + c % 1000")
    for step, metric in enumerate(H.PIPELINE_THREADS):
        add(0, metric, f"50 + c % {40 + step}")
    for weight, plugin in enumerate(H.PLUGINS, start=1):
        add(1, H.PLUGIN_TIME, f"n * {weight} + n / 4.0", plugin=plugin)
        add(1, H.PLUGIN_OUT, f"n * {4 - weight}", plugin=plugin)
    for step, metric in enumerate(H.OUTPUT_ERRORS, start=1):
        add(1, metric, f"floor(n / {step * 50})")
    for step, kind in enumerate(("old", "young", "other"), start=1):
        add(1, H.PIPELINE_GC, f"n * {step * 3}", type=kind)
    add(2, H.GATEWAY_UP, "CASE WHEN c % 7 = 0 THEN 0 ELSE 1 END")
    add(2, H.GATEWAY_REQUESTS, "n * 11")
    add(2, H.ACCEPTED, "n * 3")
    add(2, H.HANDLED, "n * 3 - floor(n / 100)")
    for step, metric in enumerate(H.CONNECTIONS):
        add(2, metric, f"c % {10 + 5 * step}")
    add(2, "gateway_events_total", "n * 10")
    for step, reason in enumerate(("unreachable", "timer_failed"), start=1):
        add(2, "gateway_events_dropped_total", f"floor(n / {step * 20})", reason=reason)
    for step, status in enumerate(("5xx", "4xx", "2xx"), start=1):
        add(3, H.ANALYZER_REQUESTS, f"n * {step * step}", handler=H.HANDLER, status=status)
    add(3, H.ANALYZER_REQUESTS, "n", handler="/health", status="2xx")
    add(3, H.IN_PROGRESS, "c % 200")
    for le, share in (("0.005", 20), ("0.01", 50), ("0.1", 90), ("1.0", 99), ("+Inf", 100)):
        add(3, H.DURATION_BUCKET, f"floor(n * {share} / 100)", le=le)
    add(3, H.PROCESS_CPU, "n / 8.0")
    add(3, H.PROCESS_MEMORY, "1000000 + c * 10")
    add(4, H.SEARCH_CPU, "c % 100")
    for step, metric in enumerate(H.SEARCH_HEAP):
        add(4, metric, f"{4 + step} * 1000 + c % 1000")
    for step, collector in enumerate(("young", "old"), start=1):
        add(4, H.SEARCH_GC, f"floor(n / {step})", gc=collector)
    for step, pool in enumerate(("search", "write", "get"), start=1):
        add(4, H.POOL_QUEUE, f"c % {step * 30}", type=pool)
        add(4, H.POOL_REJECTED, f"floor(n / {step * 10})", type=pool)
    return rows


SCRAPES = _scrapes()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples(ts, metric, labels, value)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.selectExpr(*[f"{sql} AS {name}" for name, sql in BASE.items()])

    def sample(metric: str, labels: dict[str, str], group: int, value: str):
        tags = {"job": JOBS[group], **labels}
        return F.struct(
            F.lit(metric).alias("metric"),
            F.create_map(
                F.lit("cluster"), F.col("cluster"), F.lit("instance"), F.col("instance"),
                *[part for name, text in tags.items() for part in (F.lit(name), F.lit(text))],
            ).alias("labels"),
            F.expr(value).cast("double").alias("value"),
        )

    scrape = None
    for group in range(len(JOBS)):
        batch = F.array(*[sample(m, labels, g, value) for g, m, labels, value in SCRAPES if g == group])
        hit = F.col("grp") == group
        scrape = F.when(hit, batch) if scrape is None else scrape.when(hit, batch)
    return base.select("ts", F.inline(scrape))
