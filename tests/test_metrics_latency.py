import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadlens.operators import latency as L, metrics as M
from loadlens.operators.ranks import aggregate, weighted_percentiles
from loadlens.plans import catalog as C, panels as P
from loadlens.plans.health import canonical_names

START = datetime(2024, 6, 1)


def samples(spark, rows):
    data = [(START + timedelta(seconds=s), metric, labels, float(v)) for s, metric, labels, v in rows]
    return spark.createDataFrame(data, "ts timestamp_ntz, metric string, labels map<string,string>, value double")


def test_rate_counts_resets_and_steps_across_bins(spark):
    rows = [(0, "c", {"i": "a"}, 10), (600, "c", {"i": "a"}, 30), (4000, "c", {"i": "a"}, 50), (4600, "c", {"i": "a"}, 5),
            (15000, "c", {"i": "a"}, 25), (10, "c", {"i": "b"}, 7)]
    s = samples(spark, rows)
    for every, width in (("1 hour", 3600), ("2 hours", 7200), ("10 minutes", 600), ("90 minutes", 5400)):
        got = {}
        for r in M.counter_rate(s, every).collect():
            if r.labels == {"i": "a"}:
                got[r.t] = round(r.value * width)
        want = {}
        for second, growth in ((0, 0), (600, 20), (4000, 20), (4600, 5), (15000, 20)):
            t = START + timedelta(seconds=second // width * width)
            want[t] = want.get(t, 0) + growth
        assert got == want, every
    with pytest.raises(ValueError):
        M.seconds_of("soon")


def test_label_order_does_not_make_another_series(spark):
    s = samples(spark, [(0, "c", {"a": "1", "b": "2"}, 1), (5, "c", {"b": "2", "a": "1"}, 4)])
    assert [r.value for r in M.gauge(s).collect()] == [4.0]


def test_selectors_match_whole_values(spark):
    s = samples(spark, [(0, "m", {"type": "search"}, 1), (0, "m", {"type": "searching"}, 1), (0, "n", {"type": "search"}, 1)])
    assert M.select_series(s, ["m"], match={"type": "search|write"}).count() == 1
    assert M.select_series(s, ["m", "n"], equal={"type": "search"}).count() == 2
    assert [r.value for r in M.label_values(s, "m", "type").collect()] == ["search", "searching"]


@pytest.mark.parametrize("cums,q,value", [
    ({"0.1": 10, "0.5": 30, "+Inf": 40}, 0.5, 0.3),
    ({"0.1": 10, "0.5": 30, "+Inf": 40}, 0.95, 0.5),
    ({"0.1": 10, "0.5": 30, "+Inf": 40}, 0.1, 0.04),
    ({"0.1": 0, "+Inf": 0}, 0.5, None),
])
def test_histogram_quantile(spark, cums, q, value):
    rows = [(START, {"le": le}, float(n)) for le, n in cums.items()]
    df = spark.createDataFrame(rows, "t timestamp_ntz, labels map<string,string>, value double")
    got = [r.value for r in M.histogram_quantile(df, q).collect()]
    assert got == ([] if value is None else [pytest.approx(value)])


def test_top_combine_last_state(spark):
    rows = [(START, f"i{n}", float(n)) for n in range(5)] + [(START + timedelta(hours=1), "i0", 1.0), (START + timedelta(hours=2), "i0", None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, instance string, value double")
    assert {r.instance for r in M.topk_per_step(df, 2).where(F.col("t") == START).collect()} == {"i3", "i4"}
    last = M.threshold_state(M.last_value(df, ["instance"]), [(None, "green"), (1, "yellow"), (3, "red")])
    assert {r.instance: (r.value, r.state) for r in last.collect()} == {
        "i0": (1.0, "yellow"), "i1": (1.0, "yellow"), "i2": (2.0, "yellow"), "i3": (3.0, "red"), "i4": (4.0, "red")}
    a, b = (df.where("instance = '%s'" % i).select("t", "value") for i in ("i4", "i2"))
    assert M.combine(a, b, "ratio").first().value == 2.0 and M.combine(a, b, "difference").first().value == 2.0


def test_prefixed_gateway_counters_are_recognised(spark):
    s = samples(spark, [(0, "acme_gateway_events_total", {}, 1), (0, "nginx_up", {}, 1)])
    assert {r.metric for r in canonical_names(s).collect()} == {"gateway_events_total", "nginx_up"}


def test_percentiles_interpolate(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    shares = {f"p{p}": (f"percentile_{p}", "v") for p in (0, 50, 95, 100)}
    assert aggregate(df, [], shares).first()[:] == (0.0, 50.0, 95.0, 100.0)
    assert L.latency_report(latency(spark, [])).collect() == []
    nothing = L._percentiles_by(latency(spark, [("gateway", 1, "s", None, 200)]), ["op"]).first()
    assert nothing[:] == ("s", 0.0, 0.0, 0.0)


def latency(spark, rows):
    data = [(START + timedelta(seconds=n), *r, "x" * 600) for n, r in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp_ntz, path_name string, workers int, op string, latency_ms double, status int, body string")


def test_latency_reports(spark):
    rows = [("gateway", 1, "s", 11.0, 200), ("direct", 1, "s", 10.0, 200), ("gateway", 8, "s", 13.0, 200), ("direct", 8, "s", 10.0, 200),
            ("gateway", 8, "s", 99.0, 0), ("direct", 1, "s", 99.0, 503)]
    df = latency(spark, rows)
    report = {r.op: r for r in L.latency_report(df).collect()}
    assert report["TOTAL"]["count"] == 6 and report["s"].errors == 2 and report["s"].max == 99.0
    assert report["TOTAL"].rate == pytest.approx(6 / 5)
    assert [(r.status, len(r.body)) for r in L.error_samples(df).collect()] == [(0, 512), (503, 512)]
    over = L.REPORTS["latency_overhead"](df).first()
    assert over.overhead_p50 == pytest.approx(20.0) and over.passed is False
    scale = L.REPORTS["latency_scaling"](df).first()
    assert (scale.rounds, scale.passed) == (2, False) and scale.ratio == pytest.approx(3.0)


def test_integrity(spark):
    written = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)], "id int, x string, y double")
    read = spark.createDataFrame([(1, "a", None), (2, "b", 9.0), (4, "d", 0.0)], "id int, x string, y double")
    assert L.integrity(written, read, "id").first()[:] == (3, 2, 1, 3, False)
    assert L.integrity(written, written, "id").first().passed is True


def test_panel_helpers(spark):
    assert P.auto_interval(3600) == "5 seconds" and P.auto_interval(30 * 86400) == "3600 seconds"
    assert P.auto_interval(10**9) == "1036800 seconds" or P.auto_interval(10**9).endswith(" seconds")
    with pytest.raises(ValueError):
        P.metric("median", "x")
    df = spark.createDataFrame([([],), (["a", "b"],)], "stress_cost_indicator_names array<string>")
    got = P.bar(df, P.INDICATOR_NAMES, "n", "count").collect()
    assert [(r.bucket, r.n) for r in got] == [("a", 1), ("b", 1), ("unflagged", 1)]


def test_filtered_metrics_do_not_limit_each_other(spark):
    df = spark.createDataFrame([(START, 200, 1.0), (START, 500, 3.0)], "timestamp timestamp_ntz, response_status int, took double")
    out = P.trend_multi(df, {"errors": ("count", None, "response_status >= 400"), "total": ("count", None), "slow": ("avg", "took", "response_status >= 400")})
    assert out.first()[1:] == (1, 2, 3.0)


@pytest.mark.parametrize("op", ["avg", "sum", "count", "max", "percentile_95"])
def test_top_series_against_a_plain_ranking(spark, op):
    draw = random.Random(5)
    rows = [(START + timedelta(minutes=draw.randint(0, 600)), f"s{min(draw.randint(0, 9), draw.randint(0, 9))}", float(draw.randint(0, 99))) for _ in range(500)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, name string, took double")
    got = {(r.t, r.series): r.value for r in P.trend(df, "name", op, "took", n=3).collect()}
    counts = Counter(name for _, name, _ in rows)
    top = sorted(counts, key=lambda s: (-counts[s], s))[:3]
    cells = defaultdict(list)
    for t, name, v in rows:
        if name in top:
            cells[t.replace(minute=0, second=0), name].append(v)
    fold = {"avg": lambda v: sum(v) / len(v), "sum": sum, "count": len, "max": max, }
    assert set(got) == set(cells)
    if op != "percentile_95":
        assert all(got[k] == pytest.approx(fold[op](v)) for k, v in cells.items())
    else:
        exact = df.groupBy(P.time_bin().alias("t"), F.col("name").alias("series")).agg(F.percentile("took", 0.95).alias("v")).collect()
        assert all(got[r.t, r.series] == pytest.approx(r.v) for r in exact if r.series in top)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def stored(spark, folder, df):
    df.write.parquet(folder + "/rows")
    return spark.read.parquet(folder + "/rows")


def test_trends_and_percentiles_read_their_input_once(spark, folder):
    rows = [(START + timedelta(minutes=i), f"s{i % 7}", float(i % 50), i) for i in range(2000)]
    df = stored(spark, folder, spark.createDataFrame(rows, "timestamp timestamp_ntz, name string, took double, status int"))
    for plan in (P.trend(df, "name", "avg", "took"), P.trend_pairs(df, "name", "took"),
                 P.table(df, "name", {"n": ("count",), "p50": ("percentile_50", "took"), "p99": ("percentile_99", "took")}),
                 P.trend_multi(df, {"p95": ("percentile_95", "took"), "late": ("count", None, "status > 100")})):
        text = final_plan(plan)
        assert text.count("FileScan") == 1 and "percentile" not in text


def test_percentiles_of_a_hot_group_of_distinct_values(spark):
    """A third of all rows in one group, all values distinct; the others tie, are negative, tiny, huge or not numbers."""
    hot = spark.range(40_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 40_000 / 7 + 1000).alias("v"))
    odd = [0.0, -0.0, -1.5, 1e-12, -1e-12, 1e300, -1e300, float("nan"), float("inf"), float("-inf"), None, 5.0]
    rest = spark.range(80_000).select(
        F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("k"),
        F.element_at(F.array(*[F.lit(x).cast("double") for x in odd]), (F.col("id") / 40 % 12 + 1).cast("int")).alias("v"))
    none = spark.createDataFrame([(None, 3.0), (None, 4.0), ("empty", None)], "k string, v double")
    df = hot.unionByName(rest).unionByName(none)
    shares = {f"p{p}": p / 100 for p in (0, 5, 50, 95, 99, 100)}
    got = {r.k: r for r in aggregate(df, ["k"], {n: (f"percentile_{round(q * 100)}", "v") for n, q in shares.items()} | {"n": ("count",)}).collect()}
    want = df.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in shares.items()], F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == len(want) == 43
    for r in want:
        for name in (*shares, "n"):
            assert str(got[r.k][name]) == str(r[name]) or got[r.k][name] == pytest.approx(r[name], rel=1e-12)


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", None, 9), ("b", None, 2), ("a", 1.0, 2)], "k string, v double, n long")
    got = {r.k: r.m for r in weighted_percentiles(df, ["k"], "v", "n", {"m": 0.9}).collect()}
    assert got == {"a": pytest.approx(1.5), "b": None}


def test_all_quantiles_in_one_pass(spark):
    rows = [(START, {"le": le, "cluster": c}, v) for c, scale in (("a", 1.0), ("b", 2.0), ("empty", 0.0))
            for le, v in (("1", 2.0 * scale), ("2", 6.0 * scale), ("+Inf", 8.0 * scale))]
    df = spark.createDataFrame(rows, "t timestamp_ntz, labels map<string,string>, value double")
    shares = {"p25": .25, "p50": .5, "p99": .99}
    got = {(r.cluster, r.line): r.value for r in M.histogram_quantiles(df, shares, ("cluster",)).collect()}
    one = {(r.cluster, name): r.value for name, q in shares.items() for r in M.histogram_quantile(df, q, ("cluster",)).collect()}
    assert got == one and len(got) == 6 and got["a", "p50"] == pytest.approx(1.5) and got["b", "p99"] == 2.0


def test_bins_follow_the_range(spark):
    df = spark.createDataFrame([(START,), (START + timedelta(days=30),)], "timestamp timestamp_ntz")
    day = spark.createDataFrame([(START + timedelta(seconds=200 * i),) for i in range(400)], "timestamp timestamp_ntz")
    assert [r.t for r in P.trend(df, None, "count", None, every=None).collect()] == [START, START + timedelta(days=30)]
    bins = [r.t for r in P.trend(day, None, "count", None, every=None).collect()]
    assert all((t - datetime(1970, 1, 1)).total_seconds() % 120 == 0 for t in bins) and len(bins) == 400
    assert P.trend(day.limit(0), None, "count", None, every=None).collect() == []
    single = spark.createDataFrame([(START,)] * 3, "timestamp timestamp_ntz")
    assert [r.value for r in P.trend(single, None, "count", None, every=None).collect()] == [3]


def test_panels_take_their_own_options(spark):
    df = spark.createDataFrame([(START, f"{'t' * 70}{i}", 1.0) for i in range(4)], "timestamp timestamp_ntz, request_template string, stress_score double")
    assert len(C.run_panel("pie_template", df).collect()) == 1
    assert len(C.run_panel("pie_template", df, chars=None, n=3).collect()) == 3
    assert len(C.run_panel("trend_template", df, n=None, every="1 day").collect()) == 4
    with pytest.raises(ValueError):
        C.run_panel("pie_template", df, every="1 day")
