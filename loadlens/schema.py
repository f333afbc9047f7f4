"""Schemas: the captured payload, the wide record, the dead letter and the hourly summary.

All timestamps are TIMESTAMP_NTZ holding UTC, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()
_TAGS = T.MapType(T.StringType(), T.StringType())
_WEIGHTS = T.MapType(T.StringType(), T.DoubleType())


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One captured request/response pair.  Numbers that arrive as text stay text until they are checked.
PAYLOAD = _struct([
    ("event_time", _TS),
    ("method", _S),
    ("path", _S),
    ("headers", _TAGS),
    ("request_body", _S),
    ("response_body", _S),
    ("response_status", _S),
    ("upstream_response_time", _S),
    ("content_length", _S),
    ("response_size_bytes", _S),
    ("client_host", _S),
    ("cluster_name", _S),
])

CLAUSES = (
    "bool", "bool_must", "bool_should", "bool_filter", "bool_must_not", "terms_values", "knn", "fuzzy",
    "geo_bbox", "geo_distance", "geo_shape", "agg", "wildcard", "nested", "runtime_mapping", "script",
)

INDICATORS = (
    "has_script", "has_runtime_mapping", "has_wildcard", "has_nested", "has_fuzzy", "has_geo", "has_knn",
    "excessive_bool", "large_terms_list", "deep_aggs", "unbound_hits",
)

COMPONENTS = ("took", "shards", "hits", "docs_affected", "bulk_doc_count", "bonus")

# The wide record; the column order is part of the contract.
RECORD = _struct(
    [
        ("timestamp", _TS),
        ("identity_username", _S),
        ("identity_applicative_provider", _S),
        ("identity_user_agent", _S),
        ("identity_client_host", _S),
        ("identity_labels", _TAGS),
        ("request_method", _S),
        ("request_path", _S),
        ("request_operation", _S),
        ("request_target", _S),
        ("request_template", _S),
        ("request_body", _S),
        ("request_body_truncated", _I),
        ("request_size_bytes", _L),
        ("request_size", _L),
        ("request_geo_vertex_count", _L),
        ("request_bulk_doc_count", _L),
        ("response_status", _I),
        ("response_es_took_ms", _D),
        ("response_gateway_took_ms", _D),
        ("response_hits", _L),
        ("response_shards_total", _L),
        ("response_docs_affected", _L),
        ("response_size_bytes", _L),
    ]
    + [(f"clause_counts_{name}", _I) for name in CLAUSES]
    + [(f"cost_indicators_{name}", _I) for name in INDICATORS]
    + [("stress_score", _D), ("stress_base", _D), ("stress_multiplier", _D)]
    + [(f"stress_components_{name}", _D) for name in COMPONENTS]
    + [
        ("stress_cost_indicator_count", _I),
        ("stress_cost_indicator_names", T.ArrayType(_S)),
        ("stress_cost_indicator_multipliers", _WEIGHTS),
        ("stress_bonuses", _WEIGHTS),
        ("msearch_request_id", _S),
        ("msearch_batch_size", _I),
        ("msearch_sub_query_index", _I),
        ("cluster_name", _S),
    ]
)

DEAD_LETTER = _struct([
    ("timestamp", _TS),
    ("cluster_name", _S),
    ("error", _S),
    ("raw", _S),
    ("request_path", _S),
    ("request_method", _S),
    ("request_body", _S),
])

SUMMARY_DIMS = (
    "time_bucket", "request_template", "request_operation", "identity_applicative_provider",
    "request_target", "cluster_name",
)

# state column -> record column it summarises
SUM_STATES = {"sum_score_state": "stress_score"}
AVG_STATES = {
    "avg_score_state": "stress_score",
    "avg_base_state": "stress_base",
    "avg_multiplier_state": "stress_multiplier",
    "avg_cost_indicator_count_state": "stress_cost_indicator_count",
    "avg_es_took_ms_state": "response_es_took_ms",
    "avg_gateway_took_ms_state": "response_gateway_took_ms",
    "avg_hits_state": "response_hits",
    "avg_shards_total_state": "response_shards_total",
    "avg_docs_affected_state": "response_docs_affected",
    "avg_request_size_bytes_state": "request_size_bytes",
}
PCT_STATES = {
    "pct_es_took_ms_state": "response_es_took_ms",
    "pct_gateway_took_ms_state": "response_gateway_took_ms",
    "pct_score_state": "stress_score",
}

_MEAN = T.StructType([T.StructField("sum", _D), T.StructField("n", _L)])
SUMMARY = _struct(
    [("time_bucket", _TS)]
    + [(name, _S) for name in SUMMARY_DIMS[1:]]
    + [("count_state", _L), ("sum_score_state", _D)]
    + [(name, _MEAN) for name in AVG_STATES]
    + [(name, T.BinaryType()) for name in PCT_STATES]
)

# Columns that older record tables may lack, with the value to read instead.
LATE_RECORD_COLUMNS = {
    "request_bulk_doc_count": 0,
    "stress_components_bulk_doc_count": 0.0,
    "request_body_truncated": 0,
}
