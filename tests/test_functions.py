import base64
import gzip
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loadlens.functions import bodies as B, identity, paths
from loadlens.functions.structure import count_keyed, geo_vertices, keyed_clauses, nested_counts
from loadlens.functions.template import canonical_json, display_template, json_document, scrub
from loadlens.functions.text import byte_text, lines, seconds_to_ms, truncate_utf8, whole_number
from loadlens.sources.decompression import decompress_bodies
from loadlens.sources.payloads import explode_batches


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r.out for r in df.select("n", expr(F.col("v")).alias("out")).orderBy("n").collect()]


@pytest.mark.parametrize("method,path,operation,target", [
    ("POST", "/products/_search", "_search", "products"),
    ("GET", "/products/_doc/1", "get", "products"),
    ("HEAD", "/products/_doc/1", "get", "products"),
    ("PUT", "/products/_doc/1", "index", "products"),
    ("POST", "/products/_doc", "index", "products"),
    ("DELETE", "/products/_doc/1", "delete", "products"),
    ("PATCH", "/products/_doc/1", "index", "products"),
    ("POST", "/_bulk", "_bulk", "_all"),
    ("POST", "/a,b/_bulk", "_bulk", "a,b"),
    ("GET", "/_search/scroll", "_search", "scroll"),
    ("GET", "/_cluster/health", "_cluster", "health"),
    ("GET", "/idx/_doc/_x", "_x", "idx"),
    ("GET", "/", "get", "_all"),
    ("DELETE", "/idx", "delete", "idx"),
    ("PUT", "//idx//", "index", "idx"),
])
def test_operation_and_target(spark, method, path, operation, target):
    df = spark.createDataFrame([(method, path)], "m string, p string")
    row = df.select(paths.operation(F.col("m"), F.col("p")).alias("o"), paths.target(F.col("p")).alias("t")).first()
    assert (row.o, row.t) == (operation, target)


def test_identity(spark):
    basic = "Basic " + base64.b64encode(b"ann:pw:x").decode()
    rows = [
        ({"authorization": basic, "x-opaque-id": "shop/42"}, "ann", "shop"),
        ({"authorization": "Bearer abc", "x-app-name": "svc"}, "", "svc"),
        ({"authorization": "Basic ***", "user-agent": "curl/8.1 (x)"}, "", "curl"),
        ({"authorization": basic.lower()}, "", ""),
        ({"x-opaque-id": "/42", "x-app-name": "svc"}, "", ""),
        ({"user-agent": "My Agent/1"}, "", "My"),
        ({"x-alo-team": "a", "x-alo-": "b", "x-other": "c"}, "", ""),
    ]
    df = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, h map<string,string>").orderBy("n")
    got = df.select(identity.username(F.col("h")).alias("u"), identity.applicative_provider(F.col("h")).alias("a"),
                    identity.labels(F.col("h")).alias("l")).collect()
    assert [(g.u, g.a) for g in got] == [(u, a) for _, u, a in rows]
    assert got[-1].l == {"team": "a"} and got[0].l == {}


def test_numbers(spark):
    assert column(spark, ["0.067", "abc", "", None, " 2 "], seconds_to_ms) == [67.0, 0.0, 0.0, 0.0, 2000.0]
    assert column(spark, ["284", "x", "", "1.5", None, "-3"], whole_number) == [284, 0, 0, 0, 0, -3]


def test_truncation_never_splits_a_character(spark):
    texts = ["short", "é" * 40, "a" * 17 + "é" * 40, "日本語" * 20, "🙂" * 20, "ab🙂" * 12, "x" * 50, "x" * 51]
    for limit in (50, 33, 20, 14, 3, 0):
        got = column(spark, texts, lambda c: truncate_utf8(c, limit))
        for text, out in zip(texts, got):
            raw = text.encode()
            if limit <= 0 or len(raw) <= limit:
                assert out == text
            else:
                assert out == raw[:max(0, limit - 14)].decode(errors="ignore") + "…[TRUNCATED]"


def test_byte_text(spark):
    mojibake = "café ☕".encode().decode("latin-1")
    assert column(spark, [mojibake, "plain", "日本", "\xff\xfe", None], byte_text) == ["café ☕", "plain", "日本", "��", None]


def test_lines(spark):
    assert column(spark, ["a\r\n\n b \rc d\x85 \t\n"], lines) == [["a", " b ", "c", "d"]]


@pytest.mark.parametrize("level", [1, 6, 9])
def test_decompression(spark, level):
    text = '{"query":{"match":{"t":"naïve ☕"}}}'
    packed = gzip.compress(text.encode(), level)
    squeezed = zlib.compress(text.encode(), level)
    rows = [
        ("gzip+b64:" + base64.b64encode(packed).decode(), text),
        ("gzip+b64:" + base64.b64encode(squeezed).decode(), text),
        ("gzip+b64:" + base64.b64encode(packed[:-9]).decode(), ""),
        ("gzip+b64:" + base64.b64encode(b"plain").decode(), ""),
        (packed.decode("latin-1"), text),
        (squeezed.decode("latin-1"), text),
        ((packed + gzip.compress(b"!")).decode("latin-1"), text + "!"),
        ("x marks the spot", "x marks the spot"),
        ("日本", "日本"),
        ("", ""),
    ]
    df = spark.createDataFrame([(n, a) for n, (a, _) in enumerate(rows)], "n int, body string")
    got = [r.body for r in decompress_bodies(df, ("body",)).orderBy("n").collect()]
    assert got == [b for _, b in rows]


def test_batches(spark):
    good = {"method": "POST", "path": "/a/_search", "headers": {"user-agent": "x"}, "response_status": 200}
    odd = {"method": "POST", "path": "/b", "headers": {"authorization": ["a"]}}
    rows = [json.dumps([good, 7, odd]), "not json", '{"a":1}', "[]"]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, value string")
    got = [(r.n, r.slot, r.path, r.response_status, r.scan_error) for r in explode_batches(df).orderBy("n", "slot").collect()]
    assert got == [
        (0, 0, "/a/_search", "200", None), (0, 1, None, None, "non-object item"),
        (0, 2, "/b", None, "identity header is not a string"),
        (1, None, None, None, "unparseable payload"), (2, None, None, None, "expected JSON array"),
    ]


# -- templates ------------------------------------------------------------------------------

def blank(node):
    if isinstance(node, dict):
        return {k: blank(v) for k, v in node.items()}
    return [blank(v) for v in node] if isinstance(node, list) else "?"


def template(c):
    return display_template(scrub(canonical_json(json_document(c))))


def test_templates_equal_sorted_json_of_blanked_bodies(spark):
    bodies = [
        {"b": [1, "x, y: z", None, True, {"c": 'quo"te\\'}], "a": {"é:,": {}}},
        {"query": {"bool": {"must": []}}, "n": -1.5e10},
        {"k\"ey": " ", "🙂": 1, "t\tab": [[], [{}]]},
    ]
    got = column(spark, [json.dumps(b, ensure_ascii=bool(n % 2)) for n, b in enumerate(bodies)], template)
    assert got == [json.dumps(blank(b), sort_keys=True) for b in bodies]
    assert column(spark, ["{}", "", "nope", "[1]", '{"a":1}\n{"b":2}', ' {"a" : 1 } ', '{"a":1,"a":[2]}'], template) == [
        "", "", "", "", "", '{"a": "?"}', '{"a": ["?"]}']


# -- structure: random bodies against a direct walk -------------------------------------------

NAMES = ["bool", "must", "should", "filter", "must_not", "terms", "aggs", "aggregations", "query", "nested", "wildcard",
         "prefix", "knn", "script", "geo_shape", "geo_polygon", "shape", "coordinates", "f", "a", "b"]


def random_node(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice([1, 2.5, True, None, "s", "a:b,{"])
    if rng.random() < 0.4:
        return [random_node(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NAMES): random_node(rng, depth - 1) for _ in range(rng.randrange(1, 5))}


def walk(node, visit, parent=None):
    if isinstance(node, dict):
        for key, value in node.items():
            visit(parent, key, value)
            walk(value, visit, key)
    elif isinstance(node, list):
        for item in node:
            walk(item, visit, None)


def expected(body):
    out = dict.fromkeys(["must", "should", "filter", "must_not", "terms", "agg", "keyed"], 0)

    def visit(parent, key, value):
        size = len(value) if isinstance(value, list) else int(isinstance(value, dict))
        if parent == "bool" and key in ("must", "should", "filter", "must_not"):
            out[key] += size
        if parent == "terms" and isinstance(value, list):
            out["terms"] += size
        out["keyed"] += key in ("bool", "nested", "wildcard", "prefix", "knn", "script", "geo_shape", "geo_polygon")

    def inner(holder):
        chosen = holder.get("aggs")
        # A scalar under 'aggs' cannot be told from a falsy one in a template: both count as absent.
        if not isinstance(chosen, (dict, list)) or not chosen:
            chosen = holder.get("aggregations")
        if not isinstance(chosen, dict):
            return 0
        return sum(1 + inner(v) for v in chosen.values() if isinstance(v, dict))

    walk(body.get("query"), visit)
    walk(body.get("script_fields"), visit)
    out["agg"] = inner(body)
    return out


def test_structure_of_random_bodies(spark):
    rng = random.Random(7)
    bodies = []
    for _ in range(1500):
        body = {k: random_node(rng, 6) for k in ("query", "script_fields", "aggs", "aggregations", "other") if rng.random() < 0.7}
        bodies.append(body)
    df = spark.createDataFrame([(n, json.dumps(b)) for n, b in enumerate(bodies)], "n int, v string").repartition(4)
    df = df.withColumn("doc", json_document(F.col("v"))).withColumn("s", scrub(canonical_json(F.col("doc"))))
    parts = [F.coalesce(F.to_json(F.try_variant_get("doc", f"$[0].{k}", "variant")), F.lit("")) for k in ("query", "script_fields")]
    got = df.select("n", nested_counts(F.col("s")).alias("c"), F.size(keyed_clauses(F.concat_ws(" ", *parts))).alias("k")).collect()
    for row in got:
        want = expected(bodies[row.n])
        keyed = want.pop("keyed")
        assert (row.c.asDict() if row.c else dict.fromkeys(want, 0)) == want, bodies[row.n]
        assert row.k == keyed, bodies[row.n]


def test_keyed_clauses(spark):
    text = '{"bool":{"must":[{"prefix":{"a":"\\"fuzzy\\":"}},{"regexp":{}},{"geo_grid":{}}]},"a\\"nested":{},"x":"wildcard"}'
    df = spark.createDataFrame([(text,)], "v string").withColumn("k", keyed_clauses(F.col("v")))
    row = df.select(*[count_keyed(F.col("k"), n).alias(n) for n in ("bool", "wildcard", "geo_bbox", "nested", "fuzzy")]).first()
    assert tuple(row) == (1, 2, 1, 0, 0)


@pytest.mark.parametrize("query,vertices,malformed", [
    ({"geo_shape": {"f": {"shape": {"type": "polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]}}}}, 4, False),
    ({"geo_shape": {"f": {"shape": {"coordinates": [[[[1, 2], [3, 4]]], [[[5, 6]]]]}}}}, 3, False),
    ({"geo_shape": {"f": {"type": "point", "coordinates": [1.5, -2]}}}, 1, False),
    ({"geo_polygon": {"f": {"points": [[1, 2], [3, 4]]}}}, 0, False),
    ({"geo_shape": {"f": {"coordinates": [[1, 2]], "shape": {"coordinates": [[3, 4], [5, 6]]}}}}, 2, False),
    ({"geo_shape": {"f": {"shape": {"coordinates": [["1", "2"], [3], [], [4, 5, 6]]}}}}, 1, False),
    ({"geo_shape": {"f": {"shape": "circle"}}}, 0, True),
    ({"geo_shape": {"f": {"shape": []}}}, 0, True),
    ({"geo_shape": {"f": 5, "relation": "within"}}, 0, False),
    ({"bool": {"filter": [{"geo_shape": {"f": {"shape": {"coordinates": [[1, 2]]}}}}, {"geo_shape": {"g": {"shape": {"coordinates": [[1, 2], [3, 4]]}}}}]}}, 3, False),
    ({"match": {"coordinates": [[1, 2]]}}, 0, False),
])
def test_geo_vertices(spark, query, vertices, malformed):
    got = column(spark, [json.dumps(query, separators=(",", ":"), sort_keys=True)], geo_vertices)[0]
    assert tuple(got) == (vertices, malformed)


# -- bulk and multi-search --------------------------------------------------------------------

def test_bulk(spark):
    body = "\n".join([
        '{"index":{"_index":"b"}}', '{"x":1}', "", "broken", '{"note":1}', '{"delete":{"_index":"a"}}',
        '{"create":{"_index":"b"}}', '{"index":{"q":1}}', '{"update":{}}', '{"doc":{"index":5}}', '[1]',
    ])
    cases = [body, "", "junk\nmore", '{"index":{"_index":"z"}}']
    df = spark.createDataFrame([(n, v) for n, v in enumerate(cases)], "n int, v string").orderBy("n")
    df = df.withColumn("rows", lines(F.col("v"))).withColumn("b", B.bulk_lines(F.col("rows")))
    got = df.select(B.bulk_doc_count(F.col("b")).alias("n"), B.bulk_targets(F.col("b")).alias("t"), B.bulk_template(F.col("b")).alias("p")).collect()
    assert [tuple(g) for g in got] == [
        (4, ["a", "b"], '{"actions": ["create", "delete", "index", "update"], "target": ["a", "b"]}'),
        (0, ["_all"], ""), (0, ["_all"], ""),
        (1, ["z"], '{"actions": ["index"], "target": ["z"]}'),
    ]


def test_msearch_pairs(spark):
    body = '{"index":"a"}\n{"size":1}\n\n{}\nbroken\n{"index":["b","c"]}\n{}\n{"index":[]}\n{"q":1}\n{"lonely":1}\n'
    df = spark.createDataFrame([(body,), ("",), ("{}",)], "v string")
    df = df.withColumn("p", B.msearch_pairs(lines(F.col("v"))))
    got = df.select(F.transform("p", lambda p: B.msearch_target(p["header"], F.lit("path"))).alias("t"),
                    F.transform("p", lambda p: p["text"]).alias("x")).collect()
    assert [tuple(g) for g in got] == [(["a", "b,c", "_all"], ['{"size":1}', "{}", '{"q":1}']), ([], []), ([], [])]


def test_responses(spark):
    def one(text, operation="_search"):
        df = spark.createDataFrame([(text,)], "v string").withColumn("r", B.response_document(F.col("v"), F.lit(operation)))
        r = F.col("r")
        return tuple(df.select(
            B.took_ms(r).alias("a"), B.hits(r).alias("b"), B.hits_lower_bound(r).alias("c"), B.shards_total(r).alias("d"),
            B.docs_affected(F.lit(operation), r).alias("e"), B.metrics_problem(r).alias("f")).first())

    assert one('{"took":42,"hits":{"total":{"value":1500,"relation":"gte"}},"_shards":{"total":5}}') == (42.0, 1500, True, 5, 0, None)
    assert one('{"hits":{"total":7}}') == (0.0, 0, False, 0, 0, None)
    assert one("nope") == one("") == one("[]") == (0.0, 0, False, 0, 0, None)
    assert one('{"took":null}')[5] == "took is not a number"
    assert one('{"_shards":null}')[5] == "_shards is not an object"
    assert one('{"updated":9}', "_update_by_query")[4] == 9
    assert one('{"deleted":8}', "_delete_by_query")[4] == 8
    assert one('{"items":[{},{}]}', "_bulk")[4] == 2


def test_bulk_shards_take_the_first_count_of_each_index(spark):
    items = [("i1", 0), ("i1", 2), ("i1", 5), ("i2", 3), ("", 9), (None, 9)]
    text = json.dumps({"items": [{"index": {"_index": i, "_shards": {"total": n}}} for i, n in items]})
    df = spark.createDataFrame([(text,)], "v string").withColumn("r", B.response_document(F.col("v"), F.lit("_bulk")))
    assert df.select(B.bulk_shards_total(F.col("r")["items"])).first()[0] == 5


def test_a_long_list_is_one_token(spark):
    body = json.dumps({"query": {"terms": {"user": ["u"] * 65_000}}})
    df = spark.createDataFrame([(body,)], "v string").select(nested_counts(scrub(canonical_json(json_document(F.col("v"))))).alias("c"))
    assert df.first().c.terms == 65_000
