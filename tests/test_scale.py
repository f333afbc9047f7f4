import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks import registry
from loadlens import session
from loadlens.functions.bodies import response_document
from loadlens.operators.records import build_records
from loadlens.plans import panels as P
from loadlens.schema import PAYLOAD
from loadlens.sources.request_log import log_of_events

AT = datetime(2024, 5, 1, 12, 0, 0, 900000)
BODY = '{"query":{"bool":{"must":[{"wildcard":{"a":"x*"}},{"terms":{"b":[1,2,3]}}]}}}'


def frame(spark):
    row = {"event_time": AT, "method": "POST", "path": "/shop/_search", "headers": {}, "request_body": BODY}
    return spark.createDataFrame([tuple(row.get(name) for name in PAYLOAD.names)], PAYLOAD)


def test_conditions_do_not_repeat_the_record_job(spark):
    records = build_records(frame(spark), decompress=False)
    for condition in ("stress_cost_indicator_count >= 1", "stress_score >= 0", "clause_counts_agg + clause_counts_bool > 0",
                      "arrays_overlap(stress_cost_indicator_names, array('has_wildcard'))"):
        kept = records.where(condition).select("request_path", "stress_cost_indicator_names")
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        # Clause keys in two parts of the body, its bracket tokens, its vertices.
        assert plan.count("regexp_extract_all") == 4
        assert [tuple(r) for r in kept.collect()] == [("/shop/_search", ["has_wildcard"])]


def test_rows_of_one_row_group_reach_all_tasks(spark, folder):
    rows = 40_000
    spark.range(rows).coalesce(1).write.parquet(f"{folder}/one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = spark.read.parquet(f"{folder}/one")
        assert read.rdd.getNumPartitions() >= 4
        sizes = [r["count"] for r in session.spread(read).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= 4 and max(sizes) < rows / 2 and sum(sizes) == rows


def test_tasks_grow_with_the_table(spark):
    assert session.spread(spark.range(2 * 10**6)).rdd.getNumPartitions() == 20
    assert session.spread(spark.range(0)).rdd.getNumPartitions() == 4


def test_panels_deal_the_events_over_tasks_of_bounded_rows(spark, folder):
    spark.range(450_001).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "id % 50 AS user_id", "'view' AS event_type",
        "1.0D AS value", "'{\"k\": 3}' AS props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    for name in ("base_vs_final", "top_templates", "pie_target", "clause_trends", "summary_states", "flagged_vs_total",
                 "multiplier_by_application", "trend_target", "indicator_frequency"):
        plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        # At most 100,000 events a task, so five tasks, wherever a plan reads the events.
        deals = [line for line in plan.splitlines() if "RoundRobinPartitioning" in line]
        assert deals and all("RoundRobinPartitioning(5)" in line for line in deals), name


def test_bins_from_the_range_look_at_the_rows_once(spark):
    ends = [AT + timedelta(seconds=s, milliseconds=m) for s, m in ((0, 0), (1, 50), (1, 200), (999, 300), (5000, 0))]
    rows = spark.createDataFrame(
        [(t, name, float(i)) for i, t in enumerate(ends) for name in ("a", None, "b")], "timestamp timestamp_ntz, name string, value double")
    series = P.trend(rows, "name", "avg", "value", None, 2)
    got = [tuple(r) for r in series.collect()]
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
    bin_of = lambda t: datetime(1970, 1, 1) + timedelta(seconds=(t - datetime(1970, 1, 1)) // timedelta(seconds=5) * 5)
    want = {}
    for i, t in enumerate(ends):
        for name in (None, "a"):
            want.setdefault((bin_of(t), name), []).append(float(i))
    order = sorted(want, key=lambda k: (k[0], k[1] or ""))
    assert got == [(*k, sum(want[k]) / len(want[k])) for k in order]
    assert P.trend(rows.limit(0), "name", "avg", "value", None, 2).collect() == []


def test_stages_too_large_to_compile_are_not_fused(spark):
    events = spark.createDataFrame(
        [(1, AT, 5, "view", 2.5, '{"k": 3}')],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    stages = log_of_events(events)._jdf.queryExecution().debug().codegenToSeq()
    sizes = [int(re.search(r"\((\d+),", str(stages.apply(i)._3())).group(1)) for i in range(stages.size())]
    # The JVM interprets methods beyond this size for good, so Spark must be told to leave such stages apart.
    assert max(sizes) > 8000 and int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_response_text_is_made_once(spark):
    plan = build_records(frame(spark), decompress=False)._jdf.queryExecution().optimizedPlan().toString()
    # Whether a text is one value: for a line of a bulk body, and for the response whatever its operation.
    assert plan.count("lengthOfJsonArray") == 2


def test_texts_with_and_without_blanks_are_one_document(spark):
    for text, took in (('{"took":1}', "1"), (' \t{"took":1}\r\n', "1"), ('{"took":1} ', "1"), ('{"took":1}\n{"a":2}', None),
                       ("{", None), ("", None), (" ", None), (None, None), ("\u00a0{}", None)):
        df = spark.createDataFrame([(text,)], "v string").withColumn("r", response_document(F.col("v"), F.lit("_search")))
        assert df.select(F.to_json("r.took")).first()[0] == took, text
