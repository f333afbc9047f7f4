"""Health panels over metric samples, all clusters at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.operators import metrics as M

EVERY = "6 hours"

# Metric names of the public exporters.
UTILISATION = "logstash_stats_pipeline_flow_worker_utilization_current"
HEAP_PERCENT = "logstash_stats_jvm_mem_heap_used_percent"
BACKPRESSURE = "logstash_stats_flow_queue_backpressure_current"
FD_OPEN = "logstash_stats_process_open_file_descriptors"
FD_MAX = "logstash_stats_process_max_file_descriptors"
FLOWS = {
    "logstash_stats_pipeline_flow_input_current": "input",
    "logstash_stats_pipeline_flow_filter_current": "filter",
    "logstash_stats_pipeline_flow_output_current": "output",
}
QUEUE = "logstash_stats_pipeline_queue_events_count"
PLUGIN_TIME = "logstash_stats_pipeline_plugin_events_duration"
PLUGIN_OUT = "logstash_stats_pipeline_plugin_events_out"
PLUGINS = ("http", "elasticsearch", "ruby")
OUTPUT_ERRORS = {
    "logstash_stats_pipeline_plugin_bulk_requests_errors": "bulk_errors",
    "logstash_stats_pipeline_plugin_documents_non_retryable_failures": "non_retryable",
}
PIPELINE_UP = "logstash_stats_pipeline_up"
PIPELINE_CPU = "logstash_stats_process_cpu_percent"
PIPELINE_HEAP = {"logstash_stats_jvm_mem_heap_used_bytes": "used", "logstash_stats_jvm_mem_heap_max_bytes": "max"}
PIPELINE_GC = "logstash_stats_jvm_gc_collection_time_millis_total"
PIPELINE_THREADS = {"logstash_stats_jvm_threads_count": "current", "logstash_stats_jvm_threads_peak_count": "peak"}
GATEWAY_UP = "nginx_up"
GATEWAY_REQUESTS = "nginx_http_requests_total"
ACCEPTED, HANDLED = "nginx_connections_accepted", "nginx_connections_handled"
CONNECTIONS = {
    "nginx_connections_reading": "reading", "nginx_connections_writing": "writing", "nginx_connections_waiting": "waiting",
}
EVENTS = {"gateway_events_total": "total", "gateway_events_dropped_total": "dropped"}
ANALYZER_REQUESTS = "http_requests_total"
IN_PROGRESS = "http_requests_inprogress"
DURATION_BUCKET = "http_request_duration_highr_seconds_bucket"
PROCESS_CPU = "process_cpu_seconds_total"
PROCESS_MEMORY = "process_resident_memory_bytes"
SEARCH_CPU = "elasticsearch_process_cpu_percent"
SEARCH_HEAP = {"elasticsearch_jvm_memory_used_bytes": "used", "elasticsearch_jvm_memory_max_bytes": "max"}
SEARCH_GC = "elasticsearch_jvm_gc_collection_seconds_count"
POOL_QUEUE = "elasticsearch_thread_pool_queue_count"
POOL_REJECTED = "elasticsearch_thread_pool_rejected_count"

HANDLER = "/analyze"


def canonical_names(samples: DataFrame) -> DataFrame:
    """Gateway event counters may carry a deployment's prefix: bring them to their plain names."""
    name = F.col("metric")
    for plain in EVENTS:
        name = F.when(F.endswith(F.col("metric"), F.lit(f"_{plain}")), F.lit(plain)).otherwise(name)
    return samples.withColumn("metric", name)


def _named(names: dict[str, str]) -> Column:
    out = None
    for metric, short in names.items():
        hit = F.col("metric") == metric
        out = F.when(hit, F.lit(short)) if out is None else out.when(hit, F.lit(short))
    return out


def level(samples: DataFrame, names: dict[str, str], fn: str = "sum", by=(), equal=None, match=None) -> DataFrame:
    """(t, cluster, by..., series, value): a gauge aggregated over instances."""
    chosen = M.select_series(samples, list(names), equal, match)
    return M.aggregate_by(M.gauge(chosen, EVERY).withColumn("line", _named(names)), ("cluster", *by), fn, ("line",))


def flow(samples: DataFrame, names: dict[str, str], fn: str = "sum", by=(), equal=None, match=None) -> DataFrame:
    """(t, cluster, by..., series, value): a counter's rate aggregated over instances."""
    chosen = M.select_series(samples, list(names), equal, match)
    return M.aggregate_by(M.counter_rate(chosen, EVERY).withColumn("line", _named(names)), ("cluster", *by), fn, ("line",))


def _one(metric: str) -> dict[str, str]:
    return {metric: "value"}


def _tile(series: DataFrame, steps) -> DataFrame:
    return M.threshold_state(M.last_value(series, ("cluster",)), steps)


def _up(samples: DataFrame, metric: str) -> DataFrame:
    return M.healthy(M.gauge(M.select_series(samples, [metric]), EVERY), ("cluster",))


def _open_files(samples: DataFrame) -> DataFrame:
    """Worst share of open file descriptors; open and maximum of one instance meet in one pass."""
    pairs = M.gauge(M.select_series(samples, [FD_OPEN, FD_MAX]), EVERY)
    share = pairs.groupBy("t", "series").agg(
        F.any_value("labels").alias("labels"),
        (F.try_divide(
            F.max(F.when(F.col("metric") == FD_OPEN, F.col("value"))),
            F.max(F.when(F.col("metric") == FD_MAX, F.col("value"))),
        ) * 100).alias("value"),
    )
    return M.aggregate_by(share, ("cluster",), "max")


def _plugin_time(samples: DataFrame) -> DataFrame:
    """Seconds per event by plugin."""
    rates = M.counter_rate(M.select_series(samples, [PLUGIN_TIME, PLUGIN_OUT], match={"plugin": "|".join(PLUGINS)}), EVERY)
    spent, events = (F.sum(F.when(F.col("metric") == m, F.col("value"))) for m in (PLUGIN_TIME, PLUGIN_OUT))
    return rates.groupBy("t", M.label("cluster").alias("cluster"), M.label("plugin").alias("plugin")).agg(
        F.try_divide(spent, events).alias("value")
    )


def _dropped_connections(samples: DataFrame) -> DataFrame:
    rates = flow(samples, {ACCEPTED: "accepted", HANDLED: "handled"})
    accepted, handled = (F.col("line") == name for name in ("accepted", "handled"))
    return rates.groupBy("t", "cluster").agg(
        (F.sum(F.when(accepted, F.col("value"))) - F.sum(F.when(handled, F.col("value")))).alias("value")
    )


def _analyzer_errors(samples: DataFrame) -> DataFrame:
    """Share of responses per error class."""
    rates = M.counter_rate(M.select_series(samples, [ANALYZER_REQUESTS], {"handler": HANDLER}), EVERY)
    every = F.sum("value")

    def share(status: str) -> Column:
        return F.try_divide(F.sum(F.when(M.label("status") == status, F.col("value")).otherwise(0.0)), every)

    return rates.groupBy("t", M.label("cluster").alias("cluster")).agg(
        share("4xx").alias("share_4xx"), share("5xx").alias("share_5xx")
    )


def _latency(samples: DataFrame) -> DataFrame:
    rates = M.counter_rate(M.select_series(samples, [DURATION_BUCKET]), EVERY)
    return M.histogram_quantiles(rates, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, ("cluster",))


def _busiest(samples: DataFrame, metric: str) -> DataFrame:
    """Ten highest instances per step and cluster."""
    series = level(samples, _one(metric), "max", ("instance",)).drop("line")
    return M.topk_per_step(series, 10, ("cluster",))


Panel = Callable[[DataFrame], DataFrame]

PANELS: dict[str, Panel] = {
    "cpu_usage": lambda s: level(s, _one(SEARCH_CPU), "avg").drop("line"),
    # tiles
    "kpi_worker_utilization": lambda s: _tile(level(s, _one(UTILISATION), "avg"), ((None, "green"), (70, "yellow"), (90, "red"))),
    "kpi_max_heap": lambda s: _tile(level(s, _one(HEAP_PERCENT), "max"), ((None, "green"), (70, "yellow"), (85, "red"))),
    "kpi_backpressure": lambda s: _tile(level(s, _one(BACKPRESSURE), "max"), ((None, "green"), (1, "yellow"), (10, "red"))),
    "kpi_open_files": lambda s: _tile(_open_files(s), ((None, "green"), (70, "yellow"), (90, "red"))),
    "kpi_analyzer_load": lambda s: _tile(level(s, _one(IN_PROGRESS)), ((None, "green"), (50, "yellow"), (150, "red"))),
    "kpi_gateways_up": lambda s: _tile(
        _up(s, GATEWAY_UP).withColumnRenamed("up", "value"), ((None, "red"), (1, "green"))),
    # pipeline
    "pipeline_flow": lambda s: level(s, FLOWS),
    "pipeline_queue": lambda s: level(s, _one(QUEUE)).drop("line"),
    "pipeline_plugin_time": _plugin_time,
    "pipeline_output_errors": lambda s: flow(s, OUTPUT_ERRORS),
    # gateway
    "gateway_up": lambda s: _up(s, GATEWAY_UP),
    "gateway_request_rate": lambda s: flow(s, _one(GATEWAY_REQUESTS)).drop("line"),
    "gateway_connections": lambda s: level(s, CONNECTIONS),
    "gateway_dropped_connections": _dropped_connections,
    "gateway_dropped_by_reason": lambda s: flow(canonical_names(s), {"gateway_events_dropped_total": "dropped"}, by=("reason",)).drop("line"),
    "gateway_delivery": lambda s: flow(canonical_names(s), EVENTS),
    # analyzer
    "analyzer_request_rate": lambda s: flow(s, _one(ANALYZER_REQUESTS), equal={"handler": HANDLER}).drop("line"),
    "analyzer_error_rate": _analyzer_errors,
    "analyzer_latency": _latency,
    "analyzer_cpu": lambda s: flow(s, _one(PROCESS_CPU), "avg", equal={"job": "analyzer"}).drop("line")
        .withColumn("value", F.col("value") * 100),
    "analyzer_memory": lambda s: level(s, _one(PROCESS_MEMORY), equal={"job": "analyzer"}).drop("line"),
    # pipeline hosts
    "pipelines_up": lambda s: _up(s, PIPELINE_UP),
    "pipeline_cpu": lambda s: level(s, _one(PIPELINE_CPU), "avg").drop("line"),
    "pipeline_heap": lambda s: level(s, PIPELINE_HEAP),
    "pipeline_gc": lambda s: flow(s, _one(PIPELINE_GC), by=("type",), match={"type": "old|young"}).drop("line"),
    "pipeline_threads": lambda s: level(s, PIPELINE_THREADS),
    # search cluster
    "search_cpu": lambda s: level(s, _one(SEARCH_CPU), "avg").drop("line"),
    "search_heap": lambda s: level(s, SEARCH_HEAP),
    "search_gc": lambda s: flow(s, _one(SEARCH_GC), by=("gc",)).drop("line"),
    "search_pool_queues": lambda s: level(s, _one(POOL_QUEUE), by=("type",), match={"type": "search|write"}).drop("line"),
    "search_pool_rejected": lambda s: flow(s, _one(POOL_REJECTED), by=("type",), match={"type": "search|write"}).drop("line"),
    # per instance
    "drill_worker_utilization": lambda s: _busiest(s, UTILISATION),
    "drill_heap": lambda s: _busiest(s, HEAP_PERCENT),
    "drill_in_progress": lambda s: _busiest(s, IN_PROGRESS),
    "drill_gateway_rate": lambda s: M.topk_per_step(
        flow(s, _one(GATEWAY_REQUESTS), by=("instance",)).drop("line"), 10, ("cluster",)),
    # variables
    "variable_metric_cluster": lambda s: M.label_values(s, GATEWAY_UP, "cluster"),
    "variable_gateway_instance": lambda s: M.label_values(s, GATEWAY_UP, "instance"),
    "variable_analyzer_instance": lambda s: M.label_values(s, ANALYZER_REQUESTS, "instance"),
}
