"""The record job again, as DuckDB SQL over the events table - an independent check of the Spark one.

Clause counts come from ``json_tree`` with parent links, templates from token lists, bulk documents
from run parity; none of that is how the engine works.
"""

from __future__ import annotations

import re

from loadlens.sources.request_log import CONTENT_LENGTH, LAYERS


def log_ctes() -> str:
    """CTE ``log``: one row per usable request."""
    source = "events"
    ctes = []
    for number, layer in enumerate(LAYERS):
        columns = ",\n".join(
            f"{re.sub(r'@base64[(](.*?)[)]', r'to_base64(CAST(\1 AS BLOB))', sql)} AS {name}" for name, sql in layer.items()
        )
        ctes.append(f"layer{number} AS (SELECT {columns} FROM {source})")
        source = f"layer{number}"
    ctes.append(
        f"log AS (SELECT *, {CONTENT_LENGTH} AS content_length FROM {source} WHERE method IS NOT NULL AND path IS NOT NULL)"
    )
    return ",\n".join(ctes)


def _header(column: str) -> str:
    return f"coalesce({column}, '')"


_REQUESTS = f"""
requests AS (
  SELECT *,
    date_trunc('milliseconds', event_time) AS "timestamp",
    coalesce(cluster_name, 'default') AS cluster,
    [s FOR s IN string_split(path, '/') IF s <> ''] AS segments,
    TRY_CAST(response_status AS BIGINT) AS status,
    CAST(response_size_bytes AS BIGINT) AS size_out,
    coalesce(TRY_CAST(content_length AS BIGINT), 0) AS size_in,
    coalesce(TRY_CAST(upstream_response_time AS DOUBLE) * 1000, 0.0) AS gateway_ms,
    CASE WHEN starts_with(h_authorization, 'Basic ') THEN split_part(decode(from_base64(substr(h_authorization, 7))), ':', 1) ELSE '' END AS username,
    CASE WHEN {_header('h_opaque_id')} <> '' THEN split_part(h_opaque_id, '/', 1)
         WHEN {_header('h_app_name')} <> '' THEN h_app_name
         ELSE string_split_regex({_header('h_user_agent')}, '[/ ]')[1] END AS provider,
    CASE WHEN json_valid(request_body) AND starts_with(request_body, '{{') THEN request_body END AS doc_all,
    CASE WHEN json_valid(response_body) THEN response_body ELSE '{{}}' END AS resp
  FROM log
),
placed AS (
  SELECT *,
    coalesce(list_extract([s FOR s IN segments IF NOT starts_with(s, '_')], 1), '_all') AS path_target,
    list_extract([s FOR s IN segments IF starts_with(s, '_')], -1) AS api
  FROM requests
),
typed AS (
  SELECT *,
    CASE WHEN api IS NULL OR api = '_doc'
         THEN CASE WHEN method IN ('GET', 'HEAD') THEN 'get' WHEN method = 'DELETE' THEN 'delete' ELSE 'index' END
         ELSE api END AS op
  FROM placed
),
judged AS (
  SELECT *,
    CASE WHEN op NOT IN ('_bulk', '_msearch') THEN doc_all END AS doc,
    CASE WHEN response_status IS NOT NULL AND status IS NULL THEN 'response_status is not a number'
         WHEN coalesce(json_type(resp, '$.hits'), 'OBJECT') NOT IN ('OBJECT', 'NULL') THEN 'response has an unexpected shape'
         WHEN op = '_msearch' THEN CASE WHEN len(list_filter(json_extract(resp, '$.responses[*].took')::VARCHAR[], lambda t: TRY_CAST(t AS DOUBLE) IS NULL)) > 0 THEN 'took is not a number' END
         WHEN json_type(resp, '$.took') IS NOT NULL AND TRY_CAST(json_extract_string(resp, '$.took') AS DOUBLE) IS NULL THEN 'took is not a number'
         WHEN op = '_search' AND json_type(CASE WHEN op NOT IN ('_bulk', '_msearch') THEN doc_all END, '$.size') IS NOT NULL
              AND TRY_CAST(json_extract_string(doc_all, '$.size') AS BIGINT) IS NULL THEN 'size is not a whole number'
    END AS error
  FROM typed
),
good AS (SELECT * FROM judged WHERE error IS NULL)"""

_BULK = """
bulk_lines AS (
  SELECT event_id, pos, line, action,
    CASE WHEN action IS NOT NULL THEN coalesce(json_extract_string(line, '$.' || action || '._index'), '') END AS idx,
    coalesce(lag(action) OVER (PARTITION BY event_id ORDER BY pos) IN ('index', 'create', 'update'), false) AS after_action
  FROM (
    SELECT event_id, pos, line,
      CASE WHEN NOT json_valid(line) THEN NULL
           WHEN json_type(line, '$.index') = 'OBJECT' THEN 'index' WHEN json_type(line, '$.create') = 'OBJECT' THEN 'create'
           WHEN json_type(line, '$.update') = 'OBJECT' THEN 'update' WHEN json_type(line, '$.delete') = 'OBJECT' THEN 'delete' END AS action
    FROM (SELECT event_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
          FROM (SELECT event_id, [x FOR x IN string_split(request_body, chr(10)) IF trim(x) <> ''] AS l FROM good WHERE op = '_bulk'))
  )
),
bulk_runs AS (
  SELECT *, sum(CASE WHEN action IS NULL OR NOT after_action THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY pos) AS run
  FROM bulk_lines
),
bulk_docs AS (
  SELECT event_id, CAST(sum(CASE WHEN action IS NOT NULL AND place % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS docs,
    list_sort(list(DISTINCT action) FILTER (action IS NOT NULL)) AS actions,
    list_sort(list(DISTINCT idx) FILTER (idx <> '')) AS targets
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id, run ORDER BY pos) AS place FROM bulk_runs)
  GROUP BY event_id
),
bulk_items AS (
  SELECT event_id, generate_subscripts(i, 1) AS pos, unnest(i) AS item
  FROM (SELECT event_id, json_extract(resp, '$.items[*].*') AS i FROM good WHERE op = '_bulk')
),
bulk_shards AS (
  SELECT event_id, CAST(sum(shards) AS BIGINT) AS shards
  FROM (SELECT event_id, json_extract_string(item, '$._index') AS idx,
          arg_min(CAST(json_extract_string(item, '$._shards.total') AS BIGINT), pos)
            FILTER (CAST(json_extract_string(item, '$._shards.total') AS BIGINT) <> 0) AS shards
        FROM bulk_items GROUP BY ALL)
  GROUP BY event_id
)"""

_FANOUT = """
pairs AS (
  SELECT event_id, header, search, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS sub,
    count(*) OVER (PARTITION BY event_id) AS batch
  FROM (SELECT event_id, l[2 * p + 1] AS header, l[2 * p + 2] AS search, p AS pos
        FROM (SELECT event_id, l, unnest(range(0, len(l) // 2)) AS p
              FROM (SELECT event_id, [x FOR x IN string_split(request_body, chr(10)) IF trim(x) <> ''] AS l FROM good WHERE op = '_msearch')))
  WHERE json_valid(header) AND json_valid(search)
),
fanned AS (
  SELECT g.* REPLACE (p.search AS doc, CASE WHEN p.search = '{}' THEN '' ELSE p.search END AS request_body,
      coalesce(json_extract(g.resp, '$.responses[' || CAST(p.sub AS VARCHAR) || ']'), '{}') AS resp),
    CASE WHEN json_type(p.header, '$.index') = 'ARRAY' THEN array_to_string(json_extract_string(p.header, '$.index[*]'), ',')
         ELSE coalesce(nullif(json_extract_string(p.header, '$.index'), ''), g.path_target) END AS target,
    CAST(p.batch AS INT) AS batch, CAST(p.sub AS INT) AS sub
  FROM good g JOIN pairs p USING (event_id)
  UNION ALL BY NAME
  SELECT *, path_target AS target, 0 AS batch, 0 AS sub FROM good WHERE op <> '_msearch'
),
docs AS (SELECT DISTINCT doc FROM fanned WHERE doc IS NOT NULL),
canon AS (
  SELECT doc, '{' || array_to_string([('"' || k || '":' || CAST(json_extract(doc, '$."' || k || '"') AS VARCHAR)) FOR k IN list_sort(json_keys(doc))], ',') || '}' AS text
  FROM docs
),
templates AS (
  SELECT doc, CASE WHEN text = '{}' THEN '' ELSE array_to_string([
      CASE WHEN t LIKE '%:' THEN t || ' ' WHEN t = ',' THEN ', ' WHEN t IN ('{', '}', '[', ']') THEN t ELSE '"?"' END
      FOR t IN regexp_extract_all(text, '"(?:[^"\\\\]|\\\\.)*":?|[{}\\[\\],]|[^{}\\[\\],:"]+')], '') END AS template
  FROM canon
),
nodes AS (SELECT docs.doc AS doc, t.* FROM docs, json_tree(docs.doc) t),
counted AS (
  SELECT n.doc,
    count(*) FILTER (inside AND n.key = 'bool') AS "bool",
    coalesce(sum(kids) FILTER (inside AND p.key = 'bool' AND p.type = 'OBJECT' AND n.key = 'must'), 0) AS bool_must,
    coalesce(sum(kids) FILTER (inside AND p.key = 'bool' AND p.type = 'OBJECT' AND n.key = 'should'), 0) AS bool_should,
    coalesce(sum(kids) FILTER (inside AND p.key = 'bool' AND p.type = 'OBJECT' AND n.key = 'filter'), 0) AS bool_filter,
    coalesce(sum(kids) FILTER (inside AND p.key = 'bool' AND p.type = 'OBJECT' AND n.key = 'must_not'), 0) AS bool_must_not,
    coalesce(sum(kids) FILTER (inside AND p.key = 'terms' AND p.type = 'OBJECT' AND n.type = 'ARRAY'), 0) AS terms_values,
    count(*) FILTER ((inside AND n.key = 'knn') OR n.fullkey = '$.knn') AS knn,
    count(*) FILTER (inside AND n.key = 'fuzzy') AS fuzzy,
    count(*) FILTER (inside AND n.key IN ('geo_bounding_box', 'geo_grid')) AS geo_bbox,
    count(*) FILTER (inside AND n.key = 'geo_distance') AS geo_distance,
    count(*) FILTER (inside AND n.key IN ('geo_shape', 'geo_polygon')) AS geo_shape,
    count(*) FILTER (n.type = 'OBJECT' AND regexp_matches(n.path, '^\\$\\.(aggs|aggregations)(\\."?[a-z_0-9]+"?\\.(aggs|aggregations))*$')) AS agg,
    count(*) FILTER (inside AND n.key IN ('wildcard', 'regexp', 'prefix')) AS wildcard,
    count(*) FILTER (inside AND n.key = 'nested') AS nested,
    count(*) FILTER (p.fullkey = '$.runtime_mappings') AS runtime_mapping,
    count(*) FILTER (inside AND n.key = 'script') AS script,
    count(*) FILTER (n.type = 'ARRAY' AND contains(n.fullkey, '.geo_shape.area.shape.coordinates') AND kids >= 2
        AND json_type(n.value, '$[0]') IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS vertices
  FROM (SELECT *, starts_with(fullkey, '$.query.') OR starts_with(fullkey, '$.script_fields.') AS inside,
          CASE type WHEN 'ARRAY' THEN json_array_length(value) WHEN 'OBJECT' THEN 1 ELSE 0 END AS kids FROM nodes) n
  LEFT JOIN nodes p ON p.doc = n.doc AND p.id = n.parent
  GROUP BY n.doc
)"""

_CLAUSES = (
    "bool", "bool_must", "bool_should", "bool_filter", "bool_must_not", "terms_values", "knn", "fuzzy", "geo_bbox",
    "geo_distance", "geo_shape", "agg", "wildcard", "nested", "runtime_mapping", "script",
)
_QUERY_OPS = "('_search', '_msearch', '_count', '_explain', '_validate', '_update_by_query', '_delete_by_query')"

_MEASURED = f"""
measured AS (
  SELECT f.*,
    {", ".join(f'CASE WHEN f.op IN {_QUERY_OPS} THEN CAST(coalesce(c."{n}", 0) AS INT) ELSE 0 END AS n_{n}' for n in _CLAUSES)},
    CASE WHEN f.op IN {_QUERY_OPS} THEN CAST(coalesce(c.vertices, 0) AS BIGINT) ELSE 0 END AS vertices,
    CASE WHEN f.op = '_bulk' THEN CASE WHEN len(b.actions) > 0 THEN '{{"actions": ["' || array_to_string(b.actions, '", "') || '"], "target": ["'
           || CASE WHEN len(b.targets) > 0 THEN array_to_string(b.targets, '", "') ELSE '_all' END || '"]}}' ELSE '' END
         ELSE coalesce(t.template, '') END AS template,
    CASE WHEN f.op = '_bulk' AND f.path_target = '_all' THEN coalesce(nullif(array_to_string(b.targets, ','), ''), '_all') ELSE f.target END AS final_target,
    coalesce(b.docs, 0) AS bulk_docs,
    CASE WHEN f.op = '_bulk' AND f.gateway_ms > 0 THEN f.gateway_ms
         ELSE coalesce(TRY_CAST(json_extract_string(f.resp, '$.took') AS DOUBLE), 0.0) END AS took_ms,
    coalesce(TRY_CAST(json_extract_string(f.resp, '$.hits.total.value') AS BIGINT), 0) AS hit_count,
    coalesce(json_extract_string(f.resp, '$.hits.total.relation') = 'gte', false) AS bounded,
    CASE WHEN f.op = '_bulk' THEN coalesce(s.shards, 0)
         ELSE coalesce(TRY_CAST(json_extract_string(f.resp, '$._shards.total') AS BIGINT), 0) END AS shard_count,
    CASE f.op WHEN '_bulk' THEN coalesce(json_array_length(f.resp, '$.items'), 0)
         WHEN '_update_by_query' THEN coalesce(CAST(json_extract_string(f.resp, '$.updated') AS BIGINT), 0)
         WHEN '_delete_by_query' THEN coalesce(CAST(json_extract_string(f.resp, '$.deleted') AS BIGINT), 0) ELSE 0 END AS affected,
    CASE WHEN f.op = '_search' THEN coalesce(CAST(json_extract_string(f.doc, '$.size') AS BIGINT), 10) ELSE 0 END AS page_size
  FROM fanned f LEFT JOIN counted c USING (doc) LEFT JOIN templates t USING (doc)
  LEFT JOIN bulk_docs b ON b.event_id = f.event_id LEFT JOIN bulk_shards s ON s.event_id = f.event_id
)"""

_FLAGS = {
    "has_script": ("n_script >= 1", 1.5),
    "has_runtime_mapping": ("n_runtime_mapping >= 1", 1.5),
    "has_wildcard": ("n_wildcard >= 1", 1.3),
    "has_nested": ("n_nested >= 1", 1.3),
    "has_fuzzy": ("n_fuzzy >= 1", 1.2),
    "has_geo": ("n_geo_distance + n_geo_shape >= 1", 1.2),
    "has_knn": ("n_knn >= 1", 1.2),
    "excessive_bool": ("bool_total >= 50", 1.3),
    "large_terms_list": ("n_terms_values >= 500", 1.2),
    "deep_aggs": ("n_agg >= 10", 1.3),
    "unbound_hits": (f"bounded AND op IN {_QUERY_OPS}", 1.3),
}
_BONUS = {
    "bool_total": ("bool_total", 4, 0.10, 0.50),
    "agg_clause_count": ("n_agg", 3, 0.10, 0.50),
    "wildcard_clause_count": ("n_wildcard", 1, 0.10, 0.50),
    "nested_clause_count": ("n_nested", 1, 0.10, 0.50),
    "fuzzy_clause_count": ("n_fuzzy", 1, 0.10, 0.50),
    "geo_vertex_count": ("vertices", 10, 0.12, 0.60),
    "knn_clause_count": ("n_knn", 1, 0.10, 0.50),
    "script_clause_count": ("n_script", 1, 0.10, 0.50),
    "terms_values_count": ("n_terms_values", 50, 0.10, 0.50),
}


def _four(value: str) -> str:
    """Half-up on the shortest decimal form of the double, as Spark rounds."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 17)), 4) AS DOUBLE)"


def _score_ctes() -> str:
    flags = ", ".join(f"CAST(coalesce({test}, false) AS INT) AS f_{name}" for name, (test, _) in _FLAGS.items())
    bonus = ", ".join(
        f"CASE WHEN {n} > {at} THEN least({w} * ln(1 + {n} - {at}), {cap}) END AS b_{key}"
        for key, (n, at, w, cap) in _BONUS.items()
    )
    names = ", ".join(f"CASE WHEN f_{n} = 1 THEN '{n}' END" for n in _FLAGS)
    product = " * ".join(f"CASE WHEN f_{n} = 1 THEN {m} ELSE 1.0 END::DOUBLE" for n, (_, m) in _FLAGS.items())
    total = " + ".join(f"coalesce(b_{key}, 0.0)" for key in _BONUS)
    keys = ", ".join(f"CASE WHEN b_{key} IS NOT NULL THEN '{key}' END" for key in _BONUS)
    query, by_query = "('_search','_msearch','_count','_scroll','_explain','_validate')", "('_update_by_query','_delete_by_query')"
    return f"""
flagged AS (SELECT *, n_bool_must + n_bool_should + n_bool_filter + n_bool_must_not AS bool_total, FROM measured),
fired AS (SELECT *, {flags}, {bonus} FROM flagged),
summed AS (
  SELECT *, {product} AS multiplier, [n FOR n IN [{names}] IF n IS NOT NULL] AS names0, {total} AS bonus_all,
    [n FOR n IN [{keys}] IF n IS NOT NULL] AS bonus_keys,
    CASE WHEN op IN {query} THEN 0.5 WHEN op = '_bulk' THEN 0.45 WHEN op IN {by_query} THEN 0.4 WHEN op = '_update' THEN 0.6 ELSE 0.7 END::DOUBLE * (took_ms / 100.0) AS s_took,
    CASE WHEN op IN {query} THEN 0.15 WHEN op = '_bulk' THEN 0.0 WHEN op IN {by_query} THEN 0.25 WHEN op = '_update' THEN 0.4 ELSE 0.3 END::DOUBLE * (shard_count / 5.0) AS s_shards,
    CASE WHEN op IN {query} THEN 0.35 ELSE 0.0 END::DOUBLE * (hit_count / 500.0) AS s_hits,
    CASE WHEN op IN {by_query} THEN 0.35 ELSE 0.0 END::DOUBLE * (affected / 500.0) AS s_docs,
    CASE WHEN op = '_bulk' THEN 0.55 ELSE 0.0 END::DOUBLE * (bulk_docs / 500.0) AS s_bulk
  FROM fired
),
records AS (
  SELECT "timestamp", username AS identity_username, provider AS identity_applicative_provider,
    coalesce(h_user_agent, '') AS identity_user_agent, client_host AS identity_client_host,
    coalesce(h_team, '') AS label_team, coalesce(h_env, '') AS label_env,
    method AS request_method, path AS request_path, op AS request_operation, final_target AS request_target,
    template AS request_template, request_body, size_in AS request_size_bytes, page_size AS request_size,
    vertices AS request_geo_vertex_count, bulk_docs AS request_bulk_doc_count, CAST(status AS INT) AS response_status,
    took_ms AS response_es_took_ms, gateway_ms AS response_gateway_took_ms, hit_count AS response_hits,
    shard_count AS response_shards_total, CAST(affected AS BIGINT) AS response_docs_affected, size_out AS response_size_bytes,
    {", ".join(f"n_{n} AS clause_counts_{n}" for n in _CLAUSES)},
    {", ".join(f"f_{n} AS cost_indicators_{n}" for n in _FLAGS)},
    {_four("(s_took + s_shards + s_hits + s_docs + s_bulk + bonus_all) * multiplier")} AS stress_score,
    {_four("s_took + s_shards + s_hits + s_docs + s_bulk + bonus_all")} AS stress_base,
    multiplier AS stress_multiplier,
    {_four("s_took")} AS stress_components_took, {_four("s_shards")} AS stress_components_shards,
    {_four("s_hits")} AS stress_components_hits, {_four("s_docs")} AS stress_components_docs_affected,
    {_four("s_bulk")} AS stress_components_bulk_doc_count, {_four("bonus_all")} AS stress_components_bonus,
    CAST(len(names0) AS INT) AS stress_cost_indicator_count,
    CASE WHEN len(names0) = 0 THEN ['unflagged'] ELSE names0 END AS stress_cost_indicator_names,
    array_to_string(bonus_keys, ',') AS bonus_keys,
    batch AS msearch_batch_size, sub AS msearch_sub_query_index, cluster AS cluster_name
  FROM summed
),
dead AS (
  SELECT "timestamp", cluster AS cluster_name, error, path AS request_path, method AS request_method FROM judged WHERE error IS NOT NULL
)"""


def record_ctes() -> str:
    """WITH list that ends in ``records`` and ``dead``."""
    return ",".join([log_ctes(), _REQUESTS, _BULK, _FANOUT, _MEASURED, _score_ctes()])


def with_records(select: str) -> str:
    return f"WITH {record_ctes()}\n{select}"
