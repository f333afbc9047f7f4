"""A captured request log derived from the ``events`` table, row by row.

Each event becomes one request: views search, clicks multi-search or count, purchases write in bulk,
sign-ups write single documents, errors run by-query jobs.  The derivation is plain portable SQL, so
any SQL engine can rebuild the same log from the same events.  A share of the rows is broken on
purpose: bodies that are not JSON, sizes that are not numbers, responses of the wrong shape.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.schema import PAYLOAD
from loadlens.session import spread
from loadlens.sources.payloads import drop_unusable

_HEADERS = {
    "authorization": "h_authorization",
    "x-opaque-id": "h_opaque_id",
    "x-app-name": "h_app_name",
    "user-agent": "h_user_agent",
    "x-alo-team": "h_team",
    "x-alo-env": "h_env",
    "content-type": "h_content_type",
}


def _json_list(item: str, count: str) -> str:
    """SQL text: a JSON list of ``count`` copies of ``item``."""
    return f"'[{item}' || repeat(',{item}', {count} - 1) || ']'"


_AVERAGES = ",".join('"a%02d":{"avg":{"field":"x"}}' % n for n in range(1, 12))

_SEARCH_BODY = """CASE
  WHEN k = 97 THEN '{"query":{"match_all":{}},"size":"many"}'
  WHEN k = 99 THEN 'not json'
  WHEN k % 12 = 0 THEN '{"size": ' || ks || ', "query": {"match": {"title": "w' || cs || '"}}}'
  WHEN k % 12 = 1 THEN '{"query":{"bool":{"filter":[{"term":{"color":"red"}},{"range":{"price":{"gte":' || cs
    || '}}}],"must":{"match":{"title":"x: y, z"}},"must_not":[],"should":' || @SHOULD || '}},"size":20}'
  WHEN k % 12 = 2 THEN '{"query":{"bool":{"must":[{"wildcard":{"a":"*' || cs || '"}},{"regexp":{"b":"x.*"}},{"prefix":{"c":"p"}}]}}}'
  WHEN k % 12 = 3 THEN '{"query":{"fuzzy":{"name":{"fuzziness":2,"value":"n' || cs || '"}}}}'
  WHEN k % 12 = 4 THEN '{"query":{"nested":{"path":"p","query":{"nested":{"path":"p.q","query":{"term":{"p.q.r":' || cs || '}}}}}}}'
  WHEN k % 12 = 5 THEN '{"query":{"script_score":{"query":{"match_all":{}},"script":{"source":"doc[x] * ' || cs
    || '"}}},"script_fields":{"s1":{"script":{"source":"1"}},"s2":{"script":{"source":"2"}},"s3":{"script":{"source":"3"}}}}'
  WHEN k = 90 THEN '{"aggs":{@AVERAGES},"size":0}'
  WHEN k % 12 = 6 THEN '{"aggs":{"by_color":{"aggs":{"by_size":{"aggregations":{"avg_price":{"avg":{"field":"price"}},"max_price":{"max":{"field":"price"}}},"terms":{"field":"size"}}},"terms":{"field":"color","size":'
    || ks || '}}},"size":0}'
  WHEN k % 12 = 7 THEN '{"query":{"bool":{"filter":[{"geo_shape":{"area":{"relation":"within","shape":{"coordinates":['
    || @POINTS || '],"type":"polygon"}}}},{"geo_distance":{"distance":"' || ks
    || 'km","loc":[1,2]}},{"geo_bounding_box":{"loc":{"bottom_right":[3,4],"top_left":[1,2]}}}]}}}'
  WHEN k % 12 = 8 THEN '{"query":{"terms":{"user":' || @USERS || '}}}'
  WHEN k % 12 = 9 THEN '{"knn":{"field":"v","k":10,"query_vector":[0.5,-1,' || cs || ']},"query":{"knn":{"field":"w","query_vector":[1,2]}}}'
  WHEN k % 12 = 10 THEN '{"query":{"match_all":{}},"runtime_mappings":{"day":{"script":"emit(' || ks || ')","type":"keyword"},"hour":{"type":"long"}}}'
  ELSE CASE WHEN k % 2 = 0 THEN '{}' ELSE '' END
END"""
_SEARCH_BODY = (
    _SEARCH_BODY.replace("@SHOULD", _json_list('{"match":{"tags":"a"}}', "CASE WHEN k = 85 THEN 60 ELSE 2 + k % 7 END"))
    .replace("@POINTS", _json_list("[1.5,2.5]", "(4 + k % 20)"))
    .replace("@USERS", _json_list('"u"', "CASE WHEN k = 92 THEN 600 ELSE 3 + k END"))
    .replace("@AVERAGES", _AVERAGES)
)

_MSEARCH_BODY = """'{"index":"catalog-1"}' || chr(10) || '{"query":{"term":{"color":"c' || ks || '"}}}' || chr(10)
  || '{}' || chr(10) || '{"query":{"bool":{"should":[{"match":{"a":1}},{"wildcard":{"b":"w*"}}]}},"size":3}' || chr(10)
  || chr(10) || '{"index":["a","b"]}' || chr(10) || 'broken' || chr(10)
  || '{"index":["logs-a","logs-b"]}' || chr(10) || '{}' || chr(10)"""

_BULK_BODY = """repeat('{"index":{"_index":"orders-a"}}' || chr(10) || '{"total":' || cs || '}' || chr(10), 1 + k % 5)
  || '{"create":{"_id":"x","_index":"orders-b"}}' || chr(10) || '{"index":{"y":1}}' || chr(10)
  || CASE WHEN k % 4 = 3 THEN 'broken{' || chr(10) ELSE '' END
  || '{"delete":{"_index":"orders-c"}}' || chr(10)"""

_BULK_RESPONSE = """'{"items":[' || repeat('{"index":{"_index":"orders-a","_shards":{"total":2}}},', 1 + k % 5)
  || '{"create":{"_index":"orders-b","_shards":{"total":0}}},{"delete":{"_index":"orders-b","_shards":{"total":3}}}],"took":'
  || took || '000}'"""

_SEARCH_RESPONSE = """'{"_shards":{"total":' || shards || '},"hits":{"hits":[{"_id":"1"}],"total":{"relation":"'
  || CASE WHEN hits >= 10000 THEN 'gte' ELSE 'eq' END || '","value":'
  || CAST(CASE WHEN hits >= 10000 THEN 10000 ELSE hits END AS STRING) || '}},"took":' || took || CASE WHEN k % 9 = 4 THEN ',"items":"none","responses":3' ELSE '' END || '}'"""

_REQUEST_BODY = """CASE event_type
  WHEN 'view' THEN @SEARCH
  WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN @MSEARCH ELSE '{"query":{"range":{"price":{"lt":' || cs || '}}}}' END
  WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN '{"total":' || cs || '}' ELSE @BULK END
  WHEN 'signup' THEN '{"name":"u' || us || '"}'
  ELSE CASE WHEN k % 3 = 2 THEN '' ELSE '{"query":{"bool":{"must_not":{"term":{"keep":true}}}}}' END END"""
_REQUEST_BODY = (
    _REQUEST_BODY.replace("@SEARCH", _SEARCH_BODY).replace("@MSEARCH", _MSEARCH_BODY).replace("@BULK", _BULK_BODY)
)

_RESPONSE_BODY = """CASE event_type
  WHEN 'view' THEN CASE WHEN k = 98 THEN '{"took":null}' WHEN k = 96 THEN 'not json' ELSE @SEARCH END
  WHEN 'click' THEN CASE
    WHEN k = 99 THEN '{"hits":[1],"took":1}'
    WHEN k % 2 = 1 THEN @SEARCH
    WHEN k = 98 THEN '{"responses":[{"took":"slow"}]}'
    ELSE '{"responses":[' || @SEARCH || ',{"_shards":{"total":2},"took":7}'
      || CASE WHEN k % 4 = 0 THEN '' ELSE ',{"took":3}' END || ']}' END
  WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN '{"_shards":{"total":2},"result":"created"}' ELSE @BULK END
  WHEN 'signup' THEN '{"_shards":{"total":2},"result":"ok"}'
  ELSE '{"_shards":{"total":' || shards || '},"deleted":' || CAST(c % 211 AS STRING)
    || ',"took":' || took || ',"updated":' || CAST(c % 307 AS STRING) || '}' END"""
_RESPONSE_BODY = _RESPONSE_BODY.replace("@SEARCH", _SEARCH_RESPONSE).replace("@BULK", _BULK_RESPONSE)

# Layers of portable SQL expressions, each over the columns of the one before.
LAYERS: tuple[dict[str, str], ...] = (
    {
        "event_id": "event_id",
        "ts": "ts",
        "user_id": "user_id",
        "event_type": "event_type",
        "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
        "c": "CAST(round(value * 100) AS BIGINT)",
    },
    {
        "event_time": "ts",
        "event_id": "event_id",
        "user_id": "user_id",
        "event_type": "event_type",
        "k": "k",
        "c": "c",
        "ks": "CAST(k AS STRING)",
        "cs": "CAST(c AS STRING)",
        "us": "CAST(user_id AS STRING)",
        "took": "CAST(c % 997 AS STRING)",
        "hits": "c * 7 % 20000",
        "shards": "CAST(1 + user_id % 9 AS STRING)",
    },
    {
        "event_time": "event_time",
        "event_id": "event_id",
        "k": "k",
        "method": """CASE event_type
            WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END
            WHEN 'signup' THEN CASE WHEN k % 3 = 2 THEN 'POST' ELSE 'PUT' END
            WHEN 'error' THEN CASE WHEN k % 3 = 2 THEN 'DELETE' ELSE 'POST' END
            ELSE 'POST' END""",
        "path": """CASE event_type
            WHEN 'view' THEN '/catalog-' || CAST(user_id % 7 AS STRING) || '/_search'
            WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN '/_msearch'
                 ELSE '/catalog-' || CAST(user_id % 7 AS STRING) || '/_count' END
            WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN '/orders/_doc' WHEN 1 THEN '/_bulk'
                 ELSE '/orders-' || CAST(user_id % 3 AS STRING) || '/_bulk' END
            WHEN 'signup' THEN CASE WHEN k = 51 THEN NULL ELSE '/users/'
                 || CASE k % 3 WHEN 0 THEN '_doc' WHEN 1 THEN '_create' ELSE '_update' END || '/' || us END
            ELSE CASE k % 3 WHEN 0 THEN '/logs/_update_by_query' WHEN 1 THEN '/logs/_delete_by_query'
                 ELSE '/logs/_doc/' || cs END END""",
        "h_authorization": "CASE WHEN user_id % 5 <> 0 THEN 'Basic ' || @base64('user-' || us || ':pw') END",
        "h_opaque_id": "CASE WHEN user_id % 3 = 0 THEN 'app-' || CAST(user_id % 6 AS STRING) || '/' || cs END",
        "h_app_name": "CASE WHEN user_id % 3 = 1 THEN 'svc-' || CAST(user_id % 4 AS STRING) END",
        "h_user_agent": "'client-' || CAST(k % 5 AS STRING) || '/8.' || CAST(k % 3 AS STRING) || ' (linux)'",
        "h_team": "CASE WHEN user_id % 2 = 0 THEN 'team-' || CAST(user_id % 4 AS STRING) END",
        "h_env": "CASE WHEN k % 10 = 0 THEN 'test' ELSE 'prod' END",
        "h_content_type": "'application/json'",
        "client_host": "'10.0.' || CAST(user_id % 4 AS STRING) || '.' || us",
        "cluster_name": "CASE user_id % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'west' END",
        "response_status": """CASE
            WHEN event_type IN ('signup', 'purchase') THEN '201'
            WHEN event_type <> 'error' THEN '200'
            WHEN k = 50 THEN 'n/a'
            ELSE CASE k % 4 WHEN 0 THEN '429' WHEN 1 THEN '500' WHEN 2 THEN '499' ELSE '404' END END""",
        "upstream_response_time": """CASE WHEN k % 17 = 0 THEN '' WHEN k = 13 THEN 'abc'
            ELSE CAST(CAST(floor(c / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(c % 1000 AS STRING), 3, '0') END""",
        "response_size_bytes": "CAST(200 + c % 5000 AS STRING)",
        "request_body": _REQUEST_BODY,
        "response_body": _RESPONSE_BODY,
    },
)
CONTENT_LENGTH = "CASE WHEN k % 19 = 0 THEN '' ELSE CAST(length(request_body) AS STRING) END"


def request_log(spark: SparkSession, sf_dir: str, part: Column | None = None) -> DataFrame:
    """The derived log as payloads, unusable rows already dropped; of the events that meet ``part`` only, if it is given."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return drop_unusable(log_of_events(spread(events if part is None else events.where(part))))


def time_parts(spark: SparkSession, sf_dir: str, rows: int) -> list[Column]:
    """Conditions that part the events in the order of time, about ``rows`` or fewer in each; every event meets exactly one.

    A second is never parted, however many events it has.  An event without a time stands where a stream puts it: now.
    """
    second = F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(int(time.time())))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(second.alias("second"))
    number = -(-events.count() // rows)
    if number < 2:
        return [F.lit(True)]
    shares = [i / number for i in range(1, number)]
    # One row: the first second, and one second a border.
    first, borders = events.agg(F.min("second"), F.percentile_approx("second", shares, max(10_000, 100 * number))).first()
    edges = [None, *sorted({b for b in borders if b > first}), None]
    return [
        (F.lit(True) if low is None else second >= low) & (F.lit(True) if high is None else second < high)
        for low, high in zip(edges, edges[1:])
    ]


def log_of_events(events: DataFrame) -> DataFrame:
    df = events
    for layer in LAYERS:
        df = df.selectExpr(*[f"{sql.replace('@base64', 'base64')} AS {name}" for name, sql in layer.items()])
    headers = F.map_filter(
        F.create_map(*[part for name, column in _HEADERS.items() for part in (F.lit(name), F.col(column))]),
        lambda name, value: value.isNotNull(),
    )
    df = df.withColumn("content_length", F.expr(CONTENT_LENGTH)).withColumn("headers", headers)
    return df.select(*PAYLOAD.names)
