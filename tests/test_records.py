import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadlens.operators import baselines as B
from loadlens.operators.records import analyze, build_records, dedupe_msearch, split_dead_letters
from loadlens.operators.scoring import Baselines, Formula, ScoringModel
from loadlens.schema import DEAD_LETTER, INDICATORS, PAYLOAD, RECORD

AT = datetime(2024, 5, 1, 12, 0, 0, 123456)
AT_BASELINE = {"took": 100, "hits": {"total": {"value": 500, "relation": "eq"}}, "_shards": {"total": 5}}


def frame(spark, *payloads):
    rows = []
    for given in payloads:
        row = {"event_time": AT, "method": "POST", "path": "/shop/_search", "headers": {}, "response_body": json.dumps(AT_BASELINE), **given}
        for name in ("request_body", "response_body"):
            if isinstance(row.get(name), dict):
                row[name] = json.dumps(row[name])
        rows.append(tuple(row.get(name) for name in PAYLOAD.names))
    return spark.createDataFrame(rows, PAYLOAD)


def record(spark, **payload):
    return build_records(frame(spark, payload)).first()


BULK = "\n".join(['{"index":{"_index":"a"}}\n{"x":1}'] * 500)


@pytest.mark.parametrize("payload", [
    {},
    {"path": "/shop/_count"},
    {"path": "/_bulk", "request_body": BULK},
    {"path": "/shop/_update_by_query", "response_body": {"took": 100, "updated": 500, "_shards": {"total": 5}}},
    {"path": "/shop/_delete_by_query", "response_body": {"took": 100, "deleted": 500, "_shards": {"total": 5}}},
    {"path": "/shop/_update/1"}, {"path": "/shop/_create/1"}, {"path": "/shop/_doc/1"},
    {"path": "/shop/_doc/1", "method": "GET"}, {"path": "/shop/_doc/1", "method": "DELETE"}, {"path": "/shop/_unheard_of"},
])
def test_everything_at_baseline_scores_one(spark, payload):
    r = record(spark, **payload)
    assert r.stress_score == pytest.approx(1.0) and r.stress_base == pytest.approx(1.0) and r.stress_multiplier == 1.0
    assert r.stress_cost_indicator_names == ["unflagged"] and r.stress_cost_indicator_count == 0
    assert r.stress_bonuses == {} and r.stress_cost_indicator_multipliers == {}


def bool_body(n):
    return {"query": {"bool": {"must": [{"match": {"a": 1}}] * n}}}


@pytest.mark.parametrize("body,key,bonus", [
    (bool_body(10), "bool_total", min(0.10 * math.log(7), 0.5)),
    (bool_body(4), None, 0.0),
    (bool_body(5), "bool_total", 0.10 * math.log(2)),
    (bool_body(2000), "bool_total", 0.5),
    ({"query": {"terms": {"a": list(range(51))}}}, "terms_values_count", 0.10 * math.log(2)),
    ({"aggs": {f"a{n}": {"avg": {}} for n in range(5)}}, "agg_clause_count", 0.10 * math.log(3)),
    ({"query": {"geo_shape": {"f": {"shape": {"coordinates": [[1, 2]] * 200}}}}}, "geo_vertex_count", min(0.12 * math.log(191), 0.6)),
])
def test_bonuses(spark, body, key, bonus):
    r = record(spark, request_body=body)
    assert r.stress_components_bonus == pytest.approx(bonus, abs=1e-4)
    assert r.stress_bonuses == ({} if key is None else {key: pytest.approx(bonus, abs=1e-4)})
    assert r.stress_score == pytest.approx((1 + bonus) * r.stress_multiplier, abs=1e-3)


@pytest.mark.parametrize("body,names", [
    ({"query": {"script_score": {"script": {"source": "1"}}}}, ["has_script"]),
    ({"runtime_mappings": {"a": {}, "b": {}}}, ["has_runtime_mapping"]),
    ({"query": {"bool": {"must": [{"regexp": {}}, {"nested": {"query": {"fuzzy": {}}}}]}}}, ["has_wildcard", "has_nested", "has_fuzzy"]),
    ({"query": {"geo_distance": {}}}, ["has_geo"]),
    ({"query": {"geo_bounding_box": {}}}, []),
    ({"knn": [{"field": "v"}, {"field": "w"}]}, ["has_knn"]),
    (bool_body(50), ["excessive_bool"]), (bool_body(49), []),
    ({"query": {"terms": {"a": [1] * 300, "b": [2] * 200}}}, ["large_terms_list"]),
    ({"query": {"terms": {"a": [1] * 499}}}, []),
    ({"aggs": {f"a{n}": {} for n in range(10)}}, ["deep_aggs"]),
])
def test_indicators(spark, body, names):
    r = record(spark, request_body=body)
    assert r.stress_cost_indicator_names == (names or ["unflagged"])
    assert [n for n in INDICATORS if r[f"cost_indicators_{n}"]] == names
    assert r.stress_multiplier == pytest.approx(math.prod(r.stress_cost_indicator_multipliers.values()))


def test_unbounded_hits_flag_queries_only(spark):
    capped = {"took": 1, "hits": {"total": {"value": 10000, "relation": "gte"}}}
    assert record(spark, response_body=capped).stress_cost_indicator_names == ["unbound_hits"]
    assert record(spark, path="/shop/_scroll", response_body=capped).stress_cost_indicator_names == ["unflagged"]


def test_record_shape_and_defaults(spark):
    sparse = spark.createDataFrame([("/shop/_search",)], "path string")
    df = build_records(sparse)
    assert df.schema.names == RECORD.names and len(RECORD) == 68
    r = df.first()
    assert (r.request_method, r.cluster_name, r.response_status, r.request_size, r.msearch_request_id) == ("GET", "default", 0, 10, "")
    full = record(spark, request_body=' {"size": 3} ', upstream_response_time="0.067", content_length="284", response_status="200")
    assert full.timestamp == AT.replace(microsecond=123000)
    assert (full.response_gateway_took_ms, full.request_size_bytes, full.request_size, full.response_status) == (67.0, 284, 3, 200)


def test_bulk_latency_is_the_gateway_time(spark):
    slow = {"took": 24124260718, "items": []}
    assert record(spark, path="/_bulk", response_body=slow, upstream_response_time="24.2").response_es_took_ms == 24200.0
    assert record(spark, path="/_bulk", response_body=slow).response_es_took_ms == 24124260718.0
    assert record(spark, path="/_bulk", request_body=BULK).request_target == "a"
    assert record(spark, path="/b/_bulk", request_body=BULK).request_target == "b"


def test_long_bodies_are_cut(spark):
    r = record(spark, request_body={"query": {"match": {"a": "é" * 30000}}})
    assert r.request_body_truncated == 1 and len(r.request_body.encode()) <= 32000 and r.request_body.endswith("…[TRUNCATED]")
    assert r.request_template == '{"query": {"match": {"a": "?"}}}'


def test_msearch_fans_out(spark):
    body = '{"index":"a"}\n{"query":{"wildcard":{"x":"y"}}}\n{}\nbroken\n{"index":["b","c"]}\n{}\n{}\n{"size":"odd"}\n'
    answers = {"responses": [{"took": 5, "_shards": {"total": 2}}, {"took": 7}]}
    payloads = frame(spark, {"path": "/all/_msearch", "request_body": body, "response_body": answers, "content_length": "99"})
    records = build_records(payloads).orderBy("msearch_sub_query_index").collect()
    assert [(r.request_target, r.response_es_took_ms, r.msearch_batch_size, r.msearch_sub_query_index) for r in records] == [
        ("a", 5.0, 3, 0), ("b,c", 7.0, 3, 1), ("all", 0.0, 3, 2)]
    assert len({r.msearch_request_id for r in records}) == 1 and len(records[0].msearch_request_id) == 12
    assert [r.request_template for r in records] == ['{"query": {"wildcard": {"x": "?"}}}', "", '{"size": "?"}']
    assert records[0].cost_indicators_has_wildcard == 1
    assert dedupe_msearch(build_records(payloads)).agg(F.sum("request_size_bytes")).first()[0] == 99


@pytest.mark.parametrize("payload,error", [
    ({"request_body": {"size": "x"}}, "size is not a whole number"),
    ({"request_body": {"size": None}}, "size is not a whole number"),
    ({"response_body": {"took": None}}, "took is not a number"),
    ({"response_body": {"hits": [1]}}, "response has an unexpected shape"),
    ({"response_body": {"_shards": 5}}, "_shards is not an object"),
    ({"path": "/_bulk", "response_body": {"items": [5]}}, "response has an unexpected shape"),
    ({"path": "/_msearch", "request_body": "{}\n{}\n", "response_body": {"responses": [{"took": "x"}]}}, "took is not a number"),
    ({"response_status": "n/a"}, "response_status is not a number"),
    ({"request_body": {"query": {"geo_shape": {"f": {"shape": "s"}}}}}, "geo shape is not an object"),
])
def test_bad_requests_become_dead_letters(spark, payload, error):
    records, dead = split_dead_letters(analyze(frame(spark, payload, {"cluster_name": "fine"})))
    assert [r.cluster_name for r in records.collect()] == ["fine"]
    letter = dead.collect()
    assert dead.schema.names == DEAD_LETTER.names
    assert [d.error for d in letter] == [error] and json.loads(letter[0].raw)["method"] == "POST"


def test_parts_of_other_operations_are_not_looked_at(spark):
    odd = {"took": 7, "items": "none", "responses": [3]}
    given = [{"response_body": odd}, {"path": "/shop/_count", "response_body": odd},
             {"path": "/_bulk", "request_body": BULK, "response_body": {"took": 7, "items": [{"index": {}}], "responses": 5}},
             {"path": "/_msearch", "request_body": "{}\n{}\n", "response_body": {"items": 5, "responses": [{"took": 7}]}}]
    got = build_records(frame(spark, *given)).collect()
    assert [(r.request_operation, r.response_es_took_ms, r.response_docs_affected) for r in sorted(got, key=lambda r: r.request_operation)] == [
        ("_bulk", 7.0, 1), ("_count", 7.0, 0), ("_msearch", 7.0, 0), ("_search", 7.0, 0)]


def test_the_model_can_be_reweighted(spark):
    model = ScoringModel(baselines=Baselines(took_ms=50), formulas=(Formula(("_search",), {"took": 1.0}),)).with_thresholds(excessive_bool=2)
    r = build_records(frame(spark, {"request_body": bool_body(3)}), model=model).first()
    assert r.stress_components_took == 2.0 and r.stress_cost_indicator_names == ["excessive_bool"]
    with pytest.raises(ValueError):
        model.with_thresholds(nonsense=1)


def test_record_job_needs_no_shuffle(spark):
    plan = build_records(frame(spark, {}), decompress=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def at(minutes, took, op="_search"):
    return {"event_time": AT.replace(microsecond=0) + timedelta(minutes=minutes), "path": f"/a/{op}",
            "response_body": {"took": took, "_shards": {"total": 3}}}


def test_baselines(spark):
    rows = [at(-61, 900), at(-60, 10), at(-30, 30), at(-1, 80, "_count"), at(-2, 999, "_bulk"), at(0, 500)]
    records = build_records(frame(spark, *rows)).cache()
    moment = AT.replace(microsecond=0)
    one = B.trailing_baselines(records, moment).collect()
    assert [tuple(r) for r in one] == [(30.0, 3.0)]
    assert tuple(B.trailing_baselines(records, moment + timedelta(days=9)).first()) == (None, None)
    ticks = {r.tick: r.baseline_took_ms for r in B.asof_baselines(records).collect()}
    assert ticks[moment] == 30.0 and ticks[moment - timedelta(minutes=60)] == 900.0 and ticks[moment - timedelta(minutes=59)] == 455.0 and moment + timedelta(minutes=61) not in ticks
    rough = {r.tick: r.baseline_took_ms for r in B.asof_baselines(records, exact=False).collect()}
    assert rough.keys() == ticks.keys() and rough[moment] == 30.0
    scored = build_records(frame(spark, at(0, 60), at(-200, 60)), baselines=B.asof_baselines(records))
    got = {r.timestamp: r.stress_components_took for r in scored.collect()}
    assert got[moment] == pytest.approx(0.5 * 60 / 30) and got[moment - timedelta(minutes=200)] == pytest.approx(0.3)
    single = build_records(frame(spark, at(0, 60)), baselines=B.trailing_baselines(records, moment)).first()
    assert single.stress_components_took == pytest.approx(1.0) and single.stress_components_shards == pytest.approx(0.15)
