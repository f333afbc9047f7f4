"""DuckDB SQL for every registered query that SQL can express on the whole tables."""

from __future__ import annotations

from checks.records_sql import with_records
from loadlens.sources import latency_samples as LS, metric_samples as MS
from loadlens.plans import health as H

APP, TARGET, OP, TEMPLATE = "identity_applicative_provider", "request_target", "request_operation", "request_template"
NAMES = "stress_cost_indicator_names"
TOOK = "response_es_took_ms"
_INTEGERS = {"response_hits", "request_bulk_doc_count", "request_size_bytes"}


def agg(op: str, column: str | None = None) -> str:
    if op == "count":
        return "count(*)"
    if op.startswith("percentile_"):
        return f"round(quantile_cont(CAST({column} AS DOUBLE), {int(op.split('_')[1]) / 100}), 7)"
    if op == "sum" and column in _INTEGERS:
        return f"CAST(sum({column}) AS BIGINT)"
    return f"round({op}({column}), 7)"


def bucketed(dim: str, name: str, source: str = "records") -> str:
    column = f"unnest({dim})" if dim == NAMES else dim
    return f"(SELECT *, {column} AS {name} FROM {source})"


def label(dim: str) -> str:
    if dim == TEMPLATE:
        return "coalesce(nullif(left(bucket, 60), ''), '(no template)')"
    return "coalesce(nullif(CAST(bucket AS VARCHAR), ''), '(unknown)')"


def pie(dim: str, n: int) -> str:
    return (f"SELECT {label(dim)} AS label, round(sum(stress_score), 7) AS stress FROM {bucketed(dim, 'bucket')} "
            f"GROUP BY 1 ORDER BY round(sum(stress_score), 6) DESC, label LIMIT {n}")


def table(dim: str, metrics: dict, n: int = 10, source: str = "records", by_name: bool = False) -> str:
    columns = ", ".join(f"{agg(*spec)} AS {name}" for name, spec in metrics.items())
    first = next(iter(metrics))
    order = "bucket" if by_name else f"round({first}, 6) DESC, bucket"
    return f"SELECT * FROM (SELECT bucket, {columns} FROM {bucketed(dim, 'bucket', source)} GROUP BY bucket) ORDER BY {order} LIMIT {n}"


HOUR = "date_trunc('hour', \"timestamp\")"


def trend(dim: str | None, op: str = "avg", column: str | None = "stress_score", n: int = 5, by_metric: bool = False,
          source: str = "records") -> str:
    value = agg(op, column)
    if dim is None:
        return f"SELECT {HOUR} AS t, {value} AS value FROM {source} GROUP BY 1"
    rank = f"round({op}({column}), 6)" if by_metric and op != "count" else "count(*)"
    rows = bucketed(dim, "series", source)
    return (f"SELECT {HOUR} AS t, series, {value} AS value FROM {rows} WHERE series IN "
            f"(SELECT series FROM {rows} GROUP BY series ORDER BY {rank} DESC, series LIMIT {n}) GROUP BY 1, 2")


def multi(metrics: dict) -> str:
    columns = []
    for name, (op, column, *where) in metrics.items():
        value = f"count(*) FILTER ({where[0]})" if where else agg(op, column)
        columns.append(f"{value} AS {name}")
    return f"SELECT {HOUR} AS t, {', '.join(columns)} FROM records GROUP BY 1"


_P = {"p50_took": ("percentile_50", TOOK), "p95_took": ("percentile_95", TOOK), "p99_took": ("percentile_99", TOOK)}
_STATUS = "(SELECT *, request_operation || '/' || CAST(response_status AS VARCHAR) AS combo FROM records)"


def avgs(prefix: str, names: str) -> dict:
    return {f"avg_{n}": ("avg", f"{prefix}{n}") for n in names.split()}


def record_panels() -> dict[str, str]:
    score, count = ("sum", "stress_score"), ("count", None)
    avg_score, avg_flags, avg_mult = ("avg", "stress_score"), ("avg", "stress_cost_indicator_count"), ("avg", "stress_multiplier")
    kinds = ("CASE WHEN request_operation IN ('_bulk','_create','index') THEN 'insert' "
             "WHEN request_operation IN ('_update','_update_by_query') THEN 'update' "
             "WHEN request_operation IN ('delete','_delete_by_query') THEN 'delete' ELSE 'query' END")
    types = ("CASE WHEN clause_counts_agg > 0 THEN 'agg' WHEN clause_counts_knn > 0 THEN 'knn' "
             "WHEN clause_counts_geo_distance + clause_counts_geo_shape + clause_counts_geo_bbox > 0 THEN 'geo' "
             "WHEN clause_counts_wildcard + clause_counts_fuzzy + clause_counts_bool + clause_counts_nested > 0 THEN 'text' ELSE 'simple' END")
    out = {
        "total_stress": "SELECT round(sum(stress_score), 7) AS value FROM records",
        "pie_application": pie(APP, 8), "pie_target": pie(TARGET, 8), "pie_operation": pie(OP, 8),
        "pie_cost_indicator": pie(NAMES, 10), "pie_template": pie(TEMPLATE, 10),
        "top_templates": table(TEMPLATE, {"sum_stress": score, "avg_stress": avg_score, **_P, "avg_indicators": avg_flags, "requests": count}),
        "heaviest_operations": (
            "SELECT strftime(\"timestamp\", '%y%m%d%H%M%S') || '-' || request_operation || '-' || left(request_path, 20) AS doc_id, "
            "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS time, request_body, request_operation AS operation, request_target AS target, "
            "request_path AS path, round(stress_score, 7) AS stress, round(response_es_took_ms, 7) AS es_latency_ms, "
            f"array_to_string({NAMES}, ', ') AS cost_indicators FROM records ORDER BY stress_score DESC, \"timestamp\", request_path, "
            "msearch_sub_query_index, identity_client_host LIMIT 50"),
        "top_cost_indicators": table(NAMES, {"sum_stress": score, "avg_stress": avg_score, **_P, "requests": count}),
        "trend_application": trend(APP), "trend_target": trend(TARGET), "trend_operation": trend(OP),
        "trend_cost_indicator": trend(NAMES), "trend_template": trend(TEMPLATE, n=10),
        "docs_matched_sum": trend(None, "sum", "response_hits"), "docs_matched_avg": trend(None, "avg", "response_hits"),
        "bulk_write_sum": trend(None, "sum", "request_bulk_doc_count"), "bulk_write_avg": trend(None, "avg", "request_bulk_doc_count"),
        "request_size_sum": trend(None, "sum", "request_size_bytes"), "request_size_avg": trend(None, "avg", "request_size_bytes"),
        "es_latency": multi({"avg": ("avg", TOOK), "p50": ("percentile_50", TOOK), "p95": ("percentile_95", TOOK), "p99": ("percentile_99", TOOK)}),
        "status_by_operation": trend("combo", "count", None, 10, source=_STATUS),
        "flagged_requests": "SELECT count(*) AS value FROM records WHERE stress_cost_indicator_count >= 1",
        "avg_indicator_count": "SELECT round(avg(stress_cost_indicator_count), 7) AS value FROM records",
        "avg_multiplier": "SELECT round(avg(stress_multiplier), 7) AS value FROM records",
        "max_multiplier": "SELECT round(max(stress_multiplier), 7) AS value FROM records",
        "score_composition": table(TEMPLATE, {n: ("avg", f"stress_components_{n}") for n in ("took", "shards", "hits", "bonus")}, by_name=True),
        "base_vs_final": table(TEMPLATE, {"requests": count, "avg_base": ("avg", "stress_base"), "avg_multiplier": avg_mult,
                                          "avg_final": avg_score, "avg_indicators": avg_flags}),
        "templates_by_indicator_count": table(TEMPLATE, {"avg_indicators": avg_flags, "avg_multiplier": avg_mult,
                                                         "avg_stress": avg_score, "requests": count}),
        "score_breakdown": table(TEMPLATE, {
            "requests": count, "avg_score": avg_score, "multiplier": avg_mult, "took_weighted": ("avg", "stress_components_took"), **_P,
            "shards_weighted": ("avg", "stress_components_shards"), "shards_raw": ("avg", "response_shards_total"),
            "hits_weighted": ("avg", "stress_components_hits"), "hits_raw": ("avg", "response_hits"), "bonus": ("avg", "stress_components_bonus")}),
        "score_components_trend": multi(avgs("stress_components_", "took shards hits bonus")),
        "base_trend_template": trend(TEMPLATE, "avg", "stress_base", 10),
        "multiplier_trend_template": trend(TEMPLATE, "avg", "stress_multiplier", 10),
        "indicators_trend_application": trend(APP, "avg", "stress_cost_indicator_count", 8),
        "flagged_vs_total": multi({"flagged": ("count", None, "stress_cost_indicator_count >= 1"), "total": count}),
        "indicator_frequency": table(NAMES, {"count": count}),
        "multiplier_by_application": table(APP, {"avg_multiplier": avg_mult}, 8),
        "indicators_by_target": table(TARGET, {"avg_indicators": avg_flags}, 8),
        "multiplier_by_target": table(TARGET, {"avg_multiplier": avg_mult}, 8),
        "clause_trends": multi(avgs("clause_counts_", "terms_values agg script wildcard")),
        "bool_breakdown_trend": multi(avgs("clause_counts_", "bool_must bool_should bool_filter bool_must_not")),
        "total_rate": multi({"requests": count}),
        "error_rate": multi({"errors": ("count", None, "response_status >= 400"), "total": count}),
        "by_status": table("response_status", {"requests": count}),
        "by_application": table(APP, {"requests": count, **_P}),
        "read_volume_by_op": trend(OP, "sum", "response_hits", 8),
        "bulk_volume_by_op": trend(OP, "sum", "request_bulk_doc_count", 8),
        "payload_sizes": multi({"avg_request": ("avg", "request_size_bytes"), "avg_response": ("avg", "response_size_bytes")}),
        "top_applications": table(APP, {"requests": count}), "top_indices": table(TARGET, {"requests": count}),
        "top_users": table("identity_username", {"requests": count}),
        "operation_kind": table(kinds, {"sum_stress": score, "requests": count}),
        "query_type": table(types, {"sum_stress": score, "requests": count}, source=f"(SELECT * FROM records WHERE {kinds} = 'query')"),
        "dlq_count": f"SELECT {HOUR} AS t, cluster_name, count(*) AS dlq_docs FROM dead GROUP BY 1, 2",
        "dlq_recent": 'SELECT "timestamp" AS time, error, request_path AS path, request_method AS method FROM dead '
                      'ORDER BY "timestamp" DESC, request_path, error LIMIT 20',
    }
    for name, dim in (("request_volume", None), ("rate_by_operation", OP), ("rate_by_application", APP),
                      ("rate_by_target", TARGET), ("rate_by_template", TEMPLATE)):
        n = 5 if dim is None else 8
        series = "'count' AS series" if dim is None else "series"
        out[name] = " UNION ALL ".join(
            f"SELECT '{source}' AS source, t, {series}, value FROM ({trend(dim, 'count', None, n)})" for source in ("raw", "summary"))
    wide = ", ".join(f"max(value) FILTER (series = '{s}') AS \"{s}\"" for s in ("_search/200", "_bulk/201", "_msearch/200"))
    out["status_by_operation_wide"] = f"SELECT t, {wide} FROM ({out['status_by_operation']}) GROUP BY t"
    variables = {"cluster": "cluster_name", "application": APP, "target": TARGET, "operation": OP, "template": TEMPLATE}
    for name, column in variables.items():
        out[f"variable_{name}"] = f"SELECT DISTINCT {column} AS value FROM records ORDER BY 1 LIMIT 1000"
    for name, column in (("username", "identity_username"), ("client_host", "identity_client_host"), ("cost_indicator", f"unnest({NAMES})")):
        out[f"variable_{name}"] = (f"SELECT DISTINCT value FROM (SELECT {column} AS value FROM records "
                                   "WHERE \"timestamp\" > TIMESTAMP '2024-01-24') ORDER BY 1 LIMIT 500")
    return out


_WHO = '"timestamp", request_path, identity_client_host, msearch_sub_query_index'


def ranges() -> dict[str, str]:
    out = {}
    for name, dim, n in (("request_volume", None, 5), ("rate_by_operation", OP, 8), ("rate_by_application", APP, 8),
                         ("rate_by_target", TARGET, 8), ("rate_by_template", TEMPLATE, 8)):
        since = "(SELECT * FROM records WHERE \"timestamp\" >= TIMESTAMP '2024-01-05')"
        series = "CAST(NULL AS VARCHAR) AS series" if dim is None else "series"
        out[f"routed_{name}"] = f"SELECT t, {series}, value FROM ({trend(dim, 'count', None, n, source=since)})"
    # Bin widths to choose from, in seconds.
    steps = "1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400"
    for name, where in (("all", "true"), ("day", "\"timestamp\" >= TIMESTAMP '2024-01-09' AND \"timestamp\" < TIMESTAMP '2024-01-10'")):
        rows = f"(SELECT * FROM records WHERE {where})"
        width = (f"(SELECT min(s) FROM (SELECT unnest([{steps}]) AS s), (SELECT (epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) // 1000000 AS w "
                 f"FROM {rows}) WHERE greatest(w, 1) / s <= 1000)")
        out[f"auto_bins_{name}"] = trend(OP, n=3, source=rows).replace(
            f"SELECT {HOUR} AS t", f"SELECT make_timestamp(epoch_us(\"timestamp\") // 1000000 // {width} * {width} * 1000000) AS t")
    return out


def record_views() -> dict[str, str]:
    clauses = ", ".join(f"clause_counts_{n}" for n in (
        "bool bool_must bool_should bool_filter bool_must_not terms_values knn fuzzy geo_bbox geo_distance geo_shape agg "
        "wildcard nested runtime_mapping script").split())
    flags = ", ".join(f"cost_indicators_{n}" for n in (
        "has_script has_runtime_mapping has_wildcard has_nested has_fuzzy has_geo has_knn excessive_bool large_terms_list "
        "deep_aggs unbound_hits").split())
    parts = ", ".join(f"stress_components_{n}" for n in "took shards hits docs_affected bulk_doc_count bonus".split())
    return {
        "record_identity": f"SELECT {_WHO}, identity_username, {APP}, identity_user_agent, cluster_name, label_team, label_env FROM records",
        "record_request": f"SELECT {_WHO}, request_method, request_operation, request_target, request_template, request_body, "
                          "request_size_bytes, request_size, request_geo_vertex_count, request_bulk_doc_count FROM records",
        "record_response": f"SELECT {_WHO}, response_status, round(response_es_took_ms, 7) AS response_es_took_ms, "
                           "round(response_gateway_took_ms, 7) AS response_gateway_took_ms, response_hits, response_shards_total, "
                           "response_docs_affected, response_size_bytes FROM records",
        "record_clauses": f"SELECT {_WHO}, {clauses} FROM records",
        "record_indicators": f"SELECT {_WHO}, {flags} FROM records",
        "record_stress": f"SELECT {_WHO}, stress_score, stress_base, round(stress_multiplier, 7) AS stress_multiplier, {parts}, "
                         f"stress_cost_indicator_count, array_to_string({NAMES}, ',') AS names, bonus_keys FROM records",
        "record_msearch": f"SELECT {_WHO}, msearch_batch_size, request_target, request_template, response_hits FROM records "
                          "WHERE request_operation = '_msearch'",
        "record_msearch_ids": "SELECT g.\"timestamp\", g.path AS request_path, g.client_host AS identity_client_host, "
                              "CAST(p.sub AS INT) AS msearch_sub_query_index, left(sha256(concat_ws(chr(1), CAST(g.event_time AS VARCHAR), "
                              "g.client_host, g.path, g.request_body)), 12) AS msearch_request_id FROM good g JOIN pairs p USING (event_id)",
        "msearch_parents": "SELECT request_operation, CAST(sum(request_size_bytes) AS BIGINT) AS request_bytes, count(*) AS requests "
                           "FROM records WHERE msearch_sub_query_index = 0 GROUP BY 1",
    }


def filtered() -> dict[str, str]:
    count, score = ("count", None), ("sum", "stress_score")

    def only(where: str) -> str:
        return f"(SELECT * FROM records WHERE {where})"

    week = "\"timestamp\" >= TIMESTAMP '2024-01-08' AND \"timestamp\" < TIMESTAMP '2024-01-15'"
    dims = "request_operation IN ('_search', '_count') AND cluster_name IN ('east', 'west')"
    flags = f"list_has_any({NAMES}, ['has_script', 'has_geo'])"
    return {
        "filter_week": table(APP, {"requests": count}, source=only(week)),
        "filter_dimensions": table(TARGET, {"requests": count}, source=only(dims)),
        "filter_indicators": pie(NAMES, 10).replace("FROM records", f"FROM {only(flags)}"),
        "filter_label": pie(OP, 8).replace("FROM records", f"FROM {only(chr(34) + 'label_team' + chr(34) + " = 'team-2'")}"),
        "filter_drill": table("response_status", {"requests": count},
                              source=only("response_status >= 400 AND request_operation = '_update_by_query'")),
    }


_DIMS = f"{TEMPLATE}, {OP}, {APP}, {TARGET}, cluster_name"
_MEANS = {
    "avg_score": "stress_score", "avg_base": "stress_base", "avg_multiplier": "stress_multiplier",
    "avg_cost_indicator_count": "stress_cost_indicator_count", "avg_es_took_ms": TOOK,
    "avg_gateway_took_ms": "response_gateway_took_ms", "avg_hits": "response_hits", "avg_shards_total": "response_shards_total",
    "avg_docs_affected": "response_docs_affected", "avg_request_size_bytes": "request_size_bytes",
}


def summaries() -> dict[str, str]:
    states = ", ".join(f"round(CAST(sum({c}) AS DOUBLE), 7) AS {s}_state_sum, count({c}) AS {s}_state_n" for s, c in _MEANS.items())
    means = ", ".join(f"round(avg({c}), 7) AS {s}" for s, c in _MEANS.items())
    return {
        "summary_states": f"SELECT {HOUR} AS time_bucket, {_DIMS}, count(*) AS count_state, round(sum(stress_score), 7) AS sum_score_state, "
                          f"{states} FROM records GROUP BY ALL",
        "summary_finalized": f"SELECT {HOUR} AS time_bucket, {_DIMS}, count(*) AS count, round(sum(stress_score), 7) AS sum_score, {means} "
                             "FROM records GROUP BY ALL",
        "summary_merged_daily": "SELECT date_trunc('day', \"timestamp\")::TIMESTAMP AS time_bucket, request_operation, cluster_name, count(*) AS count, "
                                f"round(sum(stress_score), 7) AS sum_score, {means} FROM records GROUP BY ALL",
        "summary_trend_application": trend(APP, by_metric=True),
        "summary_trend_total": trend(None, "sum", "stress_score"),
        "summary_percentiles": "SELECT DISTINCT request_operation, true AS median_holds FROM records",
    }


_FEEDBACK = "TIMESTAMP '2024-01-10 12:00:00'"


def baselines() -> dict[str, str]:
    queries = "request_operation IN ('_search', '_msearch', '_count')"
    usable = "CASE WHEN {0} > 0 THEN {0} END"
    took, shards = (usable.format(f"quantile_cont(CAST({c} AS DOUBLE), 0.5)") for c in (TOOK, "response_shards_total"))
    ticks = (
        "ticks AS (SELECT m.tick, {took} AS baseline_took_ms, {shards} AS baseline_shards_total FROM "
        "(SELECT DISTINCT date_trunc('minute', \"timestamp\") + to_minutes(n) AS tick FROM records, range(1, 61) r(n) WHERE {queries}) m "
        "JOIN records q ON q.\"timestamp\" >= m.tick - INTERVAL 1 HOUR AND q.\"timestamp\" < m.tick AND {queries} GROUP BY m.tick)"
    ).format(took=took, shards=shards, queries=queries)
    query, by_query = "('_search','_msearch','_count','_scroll','_explain','_validate')", "('_update_by_query','_delete_by_query')"
    took_w = f"CASE WHEN {OP} IN {query} THEN 0.5 WHEN {OP} = '_bulk' THEN 0.45 WHEN {OP} IN {by_query} THEN 0.4 WHEN {OP} = '_update' THEN 0.6 ELSE 0.7 END::DOUBLE"
    shards_w = f"CASE WHEN {OP} IN {query} THEN 0.15 WHEN {OP} = '_bulk' THEN 0.0 WHEN {OP} IN {by_query} THEN 0.25 WHEN {OP} = '_update' THEN 0.4 ELSE 0.3 END::DOUBLE"
    return {
        "baseline_trailing": f"SELECT round({took}, 7) AS baseline_took_ms, round({shards}, 7) AS baseline_shards_total FROM records "
                             f"WHERE \"timestamp\" >= TIMESTAMP '2024-01-10 11:00:00' AND \"timestamp\" < TIMESTAMP '2024-01-10 12:00:00' AND {queries}",
        "baseline_asof": f", {ticks} SELECT tick, round(baseline_took_ms, 7) AS baseline_took_ms, "
                         "round(baseline_shards_total, 7) AS baseline_shards_total FROM ticks",
        "scored_asof": f", {ticks} SELECT {OP}, round(sum(round({took_w} * ({TOOK} / coalesce(baseline_took_ms, 100.0)), 4)), 2) AS took, "
                       f"round(sum(round({shards_w} * (response_shards_total / coalesce(baseline_shards_total, 5.0)), 4)), 2) AS shards, count(*) AS n "
                       "FROM records LEFT JOIN ticks ON tick = date_trunc('minute', \"timestamp\") GROUP BY 1",
        "scored_by_feedback": f", b AS (SELECT {took} AS b_took, {shards} AS b_shards FROM records WHERE \"timestamp\" >= {_FEEDBACK} - INTERVAL 1 HOUR "
                              f"AND \"timestamp\" < {_FEEDBACK} AND {queries}) SELECT {OP}, "
                              f"round(sum(round({took_w} * ({TOOK} / CASE WHEN \"timestamp\" >= {_FEEDBACK} THEN coalesce(b_took, 100.0) ELSE 100.0 END), 4)), 2) AS took, "
                              f"round(sum(round({shards_w} * (response_shards_total / CASE WHEN \"timestamp\" >= {_FEEDBACK} THEN coalesce(b_shards, 5.0) ELSE 5.0 END), 4)), 2) AS shards, "
                              "count(*) AS n FROM records CROSS JOIN b GROUP BY 1",
    }


def storage() -> dict[str, str]:
    """Streams and tables whose answer differs from that over the plain log."""
    request = record_views()["record_request"]
    return {
        # The watermark stands ten days before the newest request that did not fail; failed ones come after it is set.
        "live_hours": ", w AS (SELECT max(\"timestamp\") FILTER (response_status < 400) - INTERVAL 10 DAY AS mark FROM records) "
                      f"SELECT {HOUR} AS time_bucket, {OP}, cluster_name, count(*) AS count, round(sum(stress_score), 7) AS sum_score, "
                      f"round(avg(stress_score), 7) AS avg_score FROM records, w WHERE response_status < 400 OR {HOUR} + INTERVAL 1 HOUR > mark GROUP BY ALL",
        "mixed_versions": f"SELECT {OP}, count(*) AS n, 0::BIGINT AS not_default, 0::BIGINT AS missing FROM records GROUP BY 1",
        "retained_requests": f"{request} WHERE \"timestamp\" > TIMESTAMP '2024-01-17 10:30:00'",
        # Whole days only: the day that the border falls on stays.
        "catalogued_requests": f"{request} WHERE \"timestamp\" >= TIMESTAMP '2024-01-15'",
    }


def batches() -> str:
    turn = "SELECT conv_id, turn, {slot} AS slot, {method} AS method, {path} AS path, {digest} AS digest, {error} AS scan_error FROM conversations WHERE {where}"
    none = {"method": "NULL", "path": "NULL", "digest": "NULL"}
    user = "role IS NULL OR role NOT IN ('assistant', 'system')"
    return " UNION ALL ".join(turn.format(**part) for part in (
        {"slot": "0", "method": "'POST'", "path": "'/' || role || '/_search'", "digest": "md5(text)", "error": "NULL", "where": user},
        {"slot": "1", **none, "error": "'non-object item'", "where": user},
        {"slot": "2", **none, "path": "'/odd'", "error": "'identity header is not a string'", "where": user},
        {"slot": "NULL::INT", **none, "error": "'unparseable payload'", "where": "role = 'system'"},
        {"slot": "NULL::INT", **none, "error": "'expected JSON array'", "where": "role = 'assistant'"},
    ))


# -- metric samples -------------------------------------------------------------------------

_COLUMNS = ("cluster", "instance", "reason", "status", "handler", "le", "plugin", "type", "gc")


def samples_cte() -> str:
    base = ", ".join(f"{sql} AS {name}" for name, sql in MS.BASE.items())
    tags = ("reason", "status", "handler", "le", "plugin", "type", "gc")
    rows = ",\n".join(
        f"({group}, '{metric}', '{MS.JOBS[group]}', " + ", ".join(f"'{labels[t]}'" if t in labels else "NULL" for t in tags) + f", {number})"
        for number, (group, metric, labels, _) in enumerate(MS.SCRAPES))
    values = " ".join(f"WHEN {number} THEN CAST({value} AS DOUBLE)" for number, (_, _, _, value) in enumerate(MS.SCRAPES))
    return (
        f"base AS (SELECT {base} FROM events), "
        f"kinds(grp, metric, job, {', '.join(tags)}, number) AS (VALUES {rows}), "
        f"samples AS (SELECT ts, metric, cluster, instance, job, {', '.join(tags)}, CASE number {values} END AS value "
        "FROM base JOIN kinds USING (grp)), "
        "gauges AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS t, metric, cluster, instance, job, " + ", ".join(tags) +
        ", arg_max(value, ts) AS value FROM samples GROUP BY ALL), "
        "steps AS (SELECT *, lag(value) OVER (PARTITION BY metric, cluster, instance, job, " + ", ".join(tags) +
        " ORDER BY ts) AS before FROM samples), "
        "rates AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS t, metric, cluster, instance, job, " + ", ".join(tags) +
        ", sum(CASE WHEN before IS NULL THEN 0.0 WHEN value < before THEN value ELSE value - before END) / 21600 AS value FROM steps GROUP BY ALL)"
    )


def _agg_series(table_name: str, names: dict | str, fn: str, by: str = "", where: str = "true", scale: str = "") -> str:
    metrics = {names: "value"} if isinstance(names, str) else names
    line = ""
    if not isinstance(names, str):
        line = ", CASE metric " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in metrics.items()) + " END AS line"
    extra = f", {by}" if by else ""
    inside = ", ".join(f"'{m}'" for m in metrics)
    return (f"SELECT t, cluster{extra}{line}, round({fn}(value){scale}, 7) AS value FROM {table_name} "
            f"WHERE metric IN ({inside}) AND {where} GROUP BY ALL")


def _tile(series: str, steps) -> str:
    state = " ".join(f"WHEN value >= {bound} THEN '{colour}'" for bound, colour in reversed(steps[1:]))
    return (f"SELECT cluster, value, CASE {state} ELSE '{steps[0][1]}' END AS state FROM "
            f"(SELECT cluster, arg_max(value, t) AS value FROM ({series}) GROUP BY cluster)")


def _up(metric: str, name: str = "up") -> str:
    return (f"SELECT t, cluster, count(*) FILTER (value = 1) AS {name}, count(*) AS total FROM gauges WHERE metric = '{metric}' GROUP BY ALL")


def _quantiles() -> str:
    buckets = (
        "b AS (SELECT *, lag(bound) OVER w AS below, coalesce(lag(cum) OVER w, 0.0) AS before, max(cum) OVER (PARTITION BY t, cluster) AS total "
        f"FROM (SELECT t, cluster, CASE WHEN le = '+Inf' THEN 'inf'::DOUBLE ELSE le::DOUBLE END AS bound, sum(value) AS cum FROM rates "
        f"WHERE metric = '{H.DURATION_BUCKET}' GROUP BY ALL) WINDOW w AS (PARTITION BY t, cluster ORDER BY bound))")
    parts = " UNION ALL ".join(
        f"SELECT t, cluster, round(CASE WHEN isinf(bound) THEN below ELSE coalesce(below, 0.0) + (bound - coalesce(below, 0.0)) "
        f"* (total * {q} - before) / (cum - before) END, 10) AS value, 'p{round(q * 100)}' AS line FROM b WHERE total > 0 AND cum >= total * {q} "
        "QUALIFY row_number() OVER (PARTITION BY t, cluster ORDER BY bound) = 1" for q in (0.5, 0.95, 0.99))
    return f", {buckets} {parts}"


def _top(series: str) -> str:
    return f"SELECT * FROM ({series}) QUALIFY row_number() OVER (PARTITION BY t, cluster ORDER BY value DESC, instance) <= 10"


def health() -> dict[str, str]:
    level = lambda *a, **k: _agg_series("gauges", *a, **k)
    flow = lambda *a, **k: _agg_series("rates", *a, **k)
    handler = f"handler = '{H.HANDLER}'"
    files = (f"SELECT t, cluster, round(max(share), 7) AS value FROM (SELECT t, cluster, instance, max(value) FILTER (metric = '{H.FD_OPEN}') "
             f"/ max(value) FILTER (metric = '{H.FD_MAX}') * 100 AS share FROM gauges GROUP BY ALL) WHERE share IS NOT NULL GROUP BY ALL")
    dropped = "gateway_events_dropped_total"
    out = {
        "cpu_usage": level(H.SEARCH_CPU, "avg"),
        "kpi_worker_utilization": _tile(level(H.UTILISATION, "avg"), ((None, "green"), (70, "yellow"), (90, "red"))),
        "kpi_max_heap": _tile(level(H.HEAP_PERCENT, "max"), ((None, "green"), (70, "yellow"), (85, "red"))),
        "kpi_backpressure": _tile(level(H.BACKPRESSURE, "max"), ((None, "green"), (1, "yellow"), (10, "red"))),
        "kpi_open_files": _tile(files, ((None, "green"), (70, "yellow"), (90, "red"))),
        "kpi_analyzer_load": _tile(level(H.IN_PROGRESS, "sum"), ((None, "green"), (50, "yellow"), (150, "red"))),
        "kpi_gateways_up": _tile(_up(H.GATEWAY_UP, "value"), ((None, "red"), (1, "green"))),
        "pipeline_flow": level(H.FLOWS, "sum"),
        "pipeline_queue": level(H.QUEUE, "sum"),
        "pipeline_plugin_time": f"SELECT t, cluster, plugin, round(sum(value) FILTER (metric = '{H.PLUGIN_TIME}') / nullif(sum(value) "
                                f"FILTER (metric = '{H.PLUGIN_OUT}'), 0), 7) AS value FROM rates WHERE plugin IS NOT NULL GROUP BY ALL",
        "pipeline_output_errors": flow(H.OUTPUT_ERRORS, "sum"),
        "gateway_up": _up(H.GATEWAY_UP),
        "gateway_request_rate": flow(H.GATEWAY_REQUESTS, "sum"),
        "gateway_connections": level(H.CONNECTIONS, "sum"),
        "gateway_dropped_connections": f"SELECT t, cluster, round(sum(value) FILTER (metric = '{H.ACCEPTED}') - sum(value) "
                                       f"FILTER (metric = '{H.HANDLED}'), 7) AS value FROM rates WHERE metric IN ('{H.ACCEPTED}', '{H.HANDLED}') GROUP BY ALL",
        "gateway_dropped_by_reason": flow(dropped, "sum", "reason"),
        "gateway_delivery": flow(H.EVENTS, "sum"),
        "analyzer_request_rate": flow(H.ANALYZER_REQUESTS, "sum", where=handler),
        "analyzer_error_rate": "SELECT t, cluster, " + ", ".join(
            f"round(sum(CASE WHEN status = '{s}' THEN value ELSE 0.0 END) / nullif(sum(value), 0), 7) AS share_{s}" for s in ("4xx", "5xx"))
            + f" FROM rates WHERE metric = '{H.ANALYZER_REQUESTS}' AND {handler} GROUP BY ALL",
        "analyzer_latency": _quantiles(),
        "analyzer_cpu": flow(H.PROCESS_CPU, "avg", where="job = 'analyzer'", scale=" * 100"),
        "analyzer_memory": level(H.PROCESS_MEMORY, "sum", where="job = 'analyzer'"),
        "pipelines_up": _up(H.PIPELINE_UP),
        "pipeline_cpu": level(H.PIPELINE_CPU, "avg"),
        "pipeline_heap": level(H.PIPELINE_HEAP, "sum"),
        "pipeline_gc": flow(H.PIPELINE_GC, "sum", "type", "type IN ('old', 'young')"),
        "pipeline_threads": level(H.PIPELINE_THREADS, "sum"),
        "search_cpu": level(H.SEARCH_CPU, "avg"),
        "search_heap": level(H.SEARCH_HEAP, "sum"),
        "search_gc": flow(H.SEARCH_GC, "sum", "gc"),
        "search_pool_queues": level(H.POOL_QUEUE, "sum", "type", "type IN ('search', 'write')"),
        "search_pool_rejected": flow(H.POOL_REJECTED, "sum", "type", "type IN ('search', 'write')"),
        "drill_worker_utilization": _top(level(H.UTILISATION, "max", "instance")),
        "drill_heap": _top(level(H.HEAP_PERCENT, "max", "instance")),
        "drill_in_progress": _top(level(H.IN_PROGRESS, "max", "instance")),
        "drill_gateway_rate": _top(flow(H.GATEWAY_REQUESTS, "sum", "instance")),
        "variable_metric_cluster": f"SELECT DISTINCT cluster AS value FROM samples WHERE metric = '{H.GATEWAY_UP}'",
        "variable_gateway_instance": f"SELECT DISTINCT instance AS value FROM samples WHERE metric = '{H.GATEWAY_UP}'",
        "variable_analyzer_instance": f"SELECT DISTINCT instance AS value FROM samples WHERE metric = '{H.ANALYZER_REQUESTS}'",
    }
    return {name: f"WITH {samples_cte()} {sql}" for name, sql in out.items()}


# -- latency --------------------------------------------------------------------------------


def latency() -> dict[str, str]:
    columns = ", ".join(f"{sql} AS {name}" for name, sql in LS.COLUMNS.items())
    failed = "(status = 0 OR status >= 400)"
    pct = ", ".join(f"round(quantile_cont(latency_ms, {p / 100}), 7) AS p{p}" for p in (50, 95, 99))
    numbers = (f"count(*) AS count, count(*) FILTER ({failed}) AS errors, {pct}, round(max(latency_ms), 7) AS max, "
               "round(count(*) / greatest(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0.01), 7) AS rate")

    def sides(keys: str) -> str:
        each = ", ".join(f"quantile_cont(latency_ms, {p / 100}) FILTER (path_name = '{n}') AS {s}_p{p}"
                         for s, n in (("a", "gateway"), ("b", "direct")) for p in (50, 95, 99))
        over = ", ".join(f"CASE WHEN b_p{p} > 0 THEN (a_p{p} - b_p{p}) / b_p{p} * 100 ELSE 0 END AS overhead_p{p}" for p in (50, 95, 99))
        return (f"SELECT *, {over} FROM (SELECT {keys}, {each} FROM samples WHERE NOT {failed} GROUP BY {keys}) "
                "WHERE a_p50 IS NOT NULL AND b_p50 IS NOT NULL")

    rounded = ", ".join(f"round({c}, 7) AS {c}" for c in [f"{s}_p{p}" for s in "ab" for p in (50, 95, 99)] + [f"overhead_p{p}" for p in (50, 95, 99)])
    out = {
        "latency_report": f"SELECT op, {numbers} FROM samples GROUP BY op UNION ALL SELECT 'TOTAL' AS op, {numbers} FROM samples",
        "latency_errors": f"SELECT op, status, left(body, 512) AS body FROM samples WHERE {failed} ORDER BY ts, op, path_name LIMIT 10",
        "latency_overhead": f"SELECT op, {rounded}, overhead_p50 <= 15 AND overhead_p95 <= 25 AS passed FROM ({sides('op')})",
        "latency_scaling": "SELECT round(fewest, 7) AS fewest, round(most, 7) AS most, rounds, round(ratio, 7) AS ratio, coalesce(ratio < 2, true) AS passed "
                           "FROM (SELECT *, CASE WHEN rounds >= 2 AND fewest <> 0 THEN abs(most) / greatest(abs(fewest), 0.1) END AS ratio FROM "
                           "(SELECT arg_min(overhead_p50, workers) AS fewest, arg_max(overhead_p50, workers) AS most, count(*) AS rounds "
                           f"FROM ({sides('workers')})))",
    }
    out = {name: f"WITH samples AS (SELECT {columns} FROM events) {sql}" for name, sql in out.items()}
    read = ", ".join(f"{sql} AS {name}" for name, sql in LS.READ_COLUMNS.items())
    differs = " OR ".join(f"w.{c} IS DISTINCT FROM r.{c}" for c in ("o_custkey", "o_totalprice", "o_orderstatus"))
    out["write_integrity"] = (
        f"SELECT count(w.o_orderkey) AS written, count(*) FILTER (w.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL) AS found, "
        f"count(*) FILTER (w.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL AND ({differs})) AS mismatches, count(r.o_orderkey) AS total, "
        "false AS passed FROM orders w FULL JOIN (SELECT " + read + f" FROM orders WHERE {LS.READ_WHERE}) r ON w.o_orderkey = r.o_orderkey")
    return out


def bodies() -> dict[str, str]:
    # The longest prefix of at most 984 bytes: count characters whose end is within the limit.
    return {
        "compressed_bodies": "SELECT doc_id, CAST(strlen(text) AS INT) AS bytes, md5(text) AS digest FROM documents",
        "truncated_bodies": (
            "SELECT doc_id, cut, CAST(strlen(t) AS INT) AS bytes, md5(t) AS digest FROM (SELECT doc_id, CAST(strlen(text) > 1000 AS INT) AS cut, "
            "CASE WHEN strlen(text) > 1000 THEN left(text, CAST((SELECT count(*) FROM range(1, 987) r(n) "
            "WHERE strlen(left(text, n)) <= 986) AS BIGINT)) || '…[TRUNCATED]' ELSE text END AS t FROM documents)"),
    }


STORED = {
    "scanned_requests": "record_request", "scanned_plain_responses": "record_response",
    "streamed_responses": "record_response", "streamed_dead_letters": "dlq_count",
    "streamed_summary": "summary_finalized", "tabled_requests": "record_request", "tabled_dead_letters": "dlq_count",
    "compacted_summary": "summary_finalized", "delivered_twice": "record_request",
}


def oracle_sql() -> dict[str, str]:
    out = {name: with_records(sql) for name, sql in {**record_panels(), **record_views(), **filtered(), **ranges(), **summaries(), **baselines(), **storage()}.items()}
    # What went through files, streams or tables must come back as the same records.
    out |= {name: out[same] for name, same in STORED.items()}
    return {**out, **health(), **latency(), **bodies(), "array_batches": batches()}
