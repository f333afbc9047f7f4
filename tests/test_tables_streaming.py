import json
import os
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import registry, stored
from loadlens.operators.records import build_records
from loadlens.operators.summary import finalize_states
from loadlens.plans.catalog import pick_source, raw_since, routed_trend
from loadlens.plans.filters import Filters
from loadlens.schema import RECORD
from loadlens.sources import tables
from loadlens.sources.payloads import read_payloads, stream_payloads
from loadlens.sources.request_log import time_parts
from loadlens.streaming.ingest import (
    BaselineCache, drop_repeats, live_summary, process_batch, read_live_summary, start_ingest, start_live_summary,
)

HOUR = datetime(2024, 3, 1, 10)


def payload(minutes=0, took=40, path="/shop/_search", body='{"query":{"match":{"a":1}}}', **extra):
    at = HOUR + timedelta(minutes=minutes)
    return {
        "event_time": at.strftime("%Y-%m-%dT%H:%M:%S.000"), "method": "POST", "path": path,
        "headers": {"user-agent": "curl/8"}, "request_body": body,
        "response_body": json.dumps({"took": took, "hits": {"total": {"value": 5, "relation": "eq"}}, "_shards": {"total": 5}}),
        "response_status": 200, "upstream_response_time": "0.1", "content_length": "30", "response_size_bytes": 10,
        "client_host": "h", "cluster_name": "c", "not_in_schema": 1, **extra,
    }


def put(folder, name, rows):
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        out.write("".join((row if isinstance(row, str) else json.dumps(row)) + "\n" for row in rows))


def test_stream_fills_three_tables_and_merges_late_rows(spark, folder):
    source, root = f"{folder}/in", f"{folder}/out"
    put(source, "a", [payload(1, 10), payload(2, 30), "{broken", {"method": "GET"}, payload(3, body='{"size":"x"}')])
    def run():
        stream = stream_payloads(spark, source, maxFilesPerTrigger=1)
        query = start_ingest(stream, root, f"{folder}/check", once=True)
        assert query.awaitTermination(120)

    run()
    put(source, "b", [payload(4, 50), payload(90, 70)])
    run()
    records = tables.read_table(spark, "records", f"{root}/records")
    assert records.count() == 4
    dead = tables.read_table(spark, "dead_letters", f"{root}/dead_letters").collect()
    assert [d.error for d in dead] == ["size is not a whole number"]
    summary = tables.read_table(spark, "summary", f"{root}/summary")
    assert summary.count() == 3
    final = {r.time_bucket: r for r in finalize_states(summary).collect()}
    assert final[HOUR]["count"] == 3
    assert final[HOUR].avg_es_took_ms == pytest.approx(30)
    assert final[HOUR].pct_es_took_ms_p50 == pytest.approx(30)
    closed = tables.closed_batches(spark, f"{folder}/check")
    assert closed == 2 and tables.compact_summary(spark, f"{root}/summary", closed) == "0-1"
    again = tables.read_table(spark, "summary", f"{root}/summary")
    assert again.count() == 2
    assert {r.time_bucket: r["count"] for r in finalize_states(again).collect()} == {t: r["count"] for t, r in final.items()}


def test_a_repeated_batch_replaces_itself(spark, folder):
    put(f"{folder}/in", "a", [payload(1), payload(2)])
    batch = read_payloads(spark, f"{folder}/in")
    for _ in range(2):
        process_batch(batch, 7, f"{folder}/out")
    assert tables.read_table(spark, "records", f"{folder}/out/records").count() == 2
    assert tables.read_table(spark, "summary", f"{folder}/out/summary").agg(F.sum("count_state")).first()[0] == 2


def test_batches_and_plain_writes_share_a_table(spark, folder):
    put(f"{folder}/in", "a", [payload(1), payload(2)])
    records = build_records(read_payloads(spark, f"{folder}/in"))
    for batches in ((None, 7), (7, None)):
        path = f"{folder}/t{batches[0]}"
        for batch in batches:
            tables.write_table(records, "records", path, batch=batch)
        assert tables.read_table(spark, "records", path).count() == 4


def test_a_repeated_batch_may_move_to_another_day_or_vanish(spark, folder):
    path = f"{folder}/t"
    put(f"{folder}/a", "a", [payload(13 * 60 + 59), payload(13 * 60 + 59)])
    put(f"{folder}/b", "b", [payload(14 * 60 + 1)])
    for source, n in (("a", 2), ("b", 1), ("a", 2)):
        tables.write_table(build_records(read_payloads(spark, f"{folder}/{source}")), "records", path, batch=3)
        assert tables.read_table(spark, "records", path).count() == n
    tables.write_table(tables.read_table(spark, "records", path).where("false"), "records", path, batch=3)
    assert tables.read_table(spark, "records", path).count() == 0


def test_compaction_keeps_what_lands_meanwhile(spark, folder, monkeypatch):
    put(f"{folder}/in", "a", [payload(1), payload(2)])
    batch = read_payloads(spark, f"{folder}/in")
    for number in (0, 1):
        process_batch(batch, number, f"{folder}/out")
    path, merge = f"{folder}/out/summary", tables.merge_states

    def slow(rows):
        process_batch(batch, 2, f"{folder}/out")
        return merge(rows)

    monkeypatch.setattr(tables, "merge_states", slow)
    assert tables.compact_summary(spark, path, 2) == "0-1"
    monkeypatch.setattr(tables, "merge_states", merge)
    assert tables.read_table(spark, "summary", path).agg(F.sum("count_state")).first()[0] == 6
    assert tables.compact_summary(spark, path, 3) == "0-2"
    left = tables.read_table(spark, "summary", path)
    assert left.count() == 1 and left.agg(F.sum("count_state")).first()[0] == 6
    assert tables.compact(spark, "records", f"{folder}/out/records", 2) == "0-1"
    assert tables.read_table(spark, "records", f"{folder}/out/records").count() == 6


def test_replay_after_compaction_doubles_nothing(spark, folder):
    path = f"{folder}/t"
    put(f"{folder}/a", "a", [payload(1), payload(2)])
    rows = build_records(read_payloads(spark, f"{folder}/a"))
    for number in range(8):
        tables.write_table(rows, "records", path, batch=number)
    # The last batch is not committed: compaction leaves it, and its replay takes its own place.
    assert tables.compact(spark, "records", path, 7) == "0-6" and tables.compact(spark, "records", path, 7) is None
    tables.write_table(rows, "records", path, batch=7)
    assert tables.read_table(spark, "records", path).count() == 16
    with pytest.raises(ValueError, match="closed"):
        tables.write_table(rows, "records", path, batch=3)
    # A compaction that was lost before it deleted what it read, and one that was lost while it wrote.
    rows.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(f"{path}/batch=2")
    rows.withColumn("day", F.to_date("timestamp")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(
        "day").parquet(f"{path}/batch=0-7")
    assert tables.read_table(spark, "records", path).count() == 16
    assert tables.compact(spark, "records", path, 8, again=True) == "0-7"
    assert tables.read_table(spark, "records", path).count() == 16


def test_ingest_drops_what_is_delivered_twice(spark, folder):
    source, root = f"{folder}/in", f"{folder}/out"
    for name in ("a", "b"):
        put(source, name, [payload(1), payload(2), payload(3, client_host=name)])
        stream = stream_payloads(spark, source)
        assert start_ingest(stream, root, f"{folder}/check", once=True, repeats_within="1 hour").awaitTermination(120)
    assert tables.read_table(spark, "records", f"{root}/records").count() == 4
    assert tables.read_table(spark, "summary", f"{root}/summary").agg(F.sum("count_state")).first()[0] == 4


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in dirs for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def test_ingest_leaves_no_shuffle_of_payloads(spark, folder):
    put(f"{folder}/in", "a", [payload(i) for i in range(9)] * 2)
    before = shuffle_files(spark)
    assert start_ingest(
        stream_payloads(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/check", once=True, repeats_within="1 hour").awaitTermination(120)
    assert not shuffle_files(spark) - before
    assert tables.read_table(spark, "records", f"{folder}/out/records").count() == 9


def put_events(spark, folder, moments):
    rows = [(i, at, i % 50, ("view", "click", "purchase", "signup", "error")[i % 5], 1.0 + i, '{"k": %d}' % (i % 100)) for i, at in enumerate(moments)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(f"{folder}/events.parquet")


def test_a_log_is_delivered_twice_part_by_part(spark, folder, monkeypatch):
    put_events(spark, folder, [HOUR + timedelta(minutes=17 * (i * 37 % 120), milliseconds=i) for i in range(120)])
    roots, parts = [], []
    folder_of, start = stored._folder, stored.start_ingest

    def started(stream, root, *args, **options):
        parts.append(spark.read.text(roots[0]).count())
        return start(stream, root, *args, **options)

    monkeypatch.setattr(stored, "_folder", lambda s: roots.append(folder_of(s)) or roots[-1])
    monkeypatch.setattr(stored, "start_ingest", started)
    monkeypatch.setattr(stored, "DELIVERY_ROWS", 60)
    got = Counter(map(tuple, registry.queries()["delivered_twice"](spark, folder).collect()))
    want = Counter(map(tuple, registry.queries()["record_request"](spark, folder).collect()))
    assert got == want and sum(want.values()) > 100
    # Half of the log with its repeat lands before each of two runs of the stream, in compressed files.
    assert len(parts) == 2 and all(100 <= b - a <= 140 for a, b in zip([0, *parts], parts))
    assert all(name.endswith(".gz") for name in os.listdir(roots[0]) if name.startswith("part-"))


def test_time_parts_hold_every_event_once(spark, folder):
    # Many in one second, some without a time, some to come.
    moments = [HOUR] * 30 + [HOUR + timedelta(seconds=i, milliseconds=999) for i in range(50)] + [None] * 7 + [datetime(2190, 1, 1)] * 13
    put_events(spark, folder, moments)
    events = spark.read.parquet(f"{folder}/events.parquet")
    parts = [sorted(r.event_id for r in events.where(part).collect()) for part in time_parts(spark, folder, 20)]
    assert sorted(i for ids in parts for i in ids) == list(range(100)) and len(parts) >= 4
    assert [ids for ids in parts if 0 in ids][0][:30] == list(range(30))
    place = {i: number for number, ids in enumerate(parts) for i in ids}
    order = sorted(range(100), key=lambda i: moments[i] or datetime(2100, 1, 1))
    assert [place[i] for i in order] == sorted(place.values())
    assert len(time_parts(spark, folder, 100)) == 1


def test_baseline_cache(spark, folder):
    clock = [0.0]
    cache = BaselineCache(f"{folder}/out/records", ttl=60, now=lambda: HOUR + timedelta(minutes=30), clock=lambda: clock[0])
    assert cache.current(spark) is None  # nothing written yet: static baselines
    put(f"{folder}/in", "a", [payload(1, 20), payload(2, 200), payload(3, 80)])
    process_batch(read_payloads(spark, f"{folder}/in"), 0, f"{folder}/out")
    assert cache.current(spark) is None  # still within the ttl
    clock[0] = 61
    assert cache.current(spark).first().baseline_took_ms == 80
    cache.path = f"{folder}/gone"
    clock[0] = 200
    assert cache.current(spark).first().baseline_took_ms == 80  # a failed look-up keeps the values


def test_stream_drops_retries(spark, folder):
    put(f"{folder}/in", "a", [payload(1), payload(1), payload(2)])
    stream = drop_repeats(stream_payloads(spark, f"{folder}/in"))
    query = stream.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("kept").count() == 2


def test_live_summary(spark, folder):
    put(f"{folder}/in", "a", [payload(1), payload(2), payload(70)])
    process_batch(read_payloads(spark, f"{folder}/in"), 0, f"{folder}/out")
    stored = spark.read.parquet(f"{folder}/out/records").schema
    stream = spark.readStream.schema(stored).parquet(f"{folder}/out/records")
    query = live_summary(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.time_bucket.hour: r["count"] for r in spark.table("live").collect()} == {10: 2, 11: 1}


def test_live_hours_take_late_rows_until_the_watermark(spark, folder):
    def deliver(name, rows):
        put(f"{folder}/in", name, rows)
        records = build_records(stream_payloads(spark, f"{folder}/in"), decompress=False)
        assert start_live_summary(records, f"{folder}/live", f"{folder}/check", "2 hours", once=True).awaitTermination(120)
        return {r.time_bucket.hour: (r["count"], r["sum_score"] > 0) for r in read_live_summary(spark, f"{folder}/live").collect()}

    assert deliver("a", [payload(1), payload(70), payload(200)]) == {10: (1, True), 11: (1, True), 13: (1, True)}
    # The watermark is 11:20: the hour from 10 is closed, the one from 11 still counts.
    assert deliver("b", [payload(2), payload(80), payload(190)]) == {10: (1, True), 11: (2, True), 13: (2, True)}


def test_a_stream_scores_by_what_it_wrote(spark, folder):
    cache = BaselineCache(f"{folder}/out/records", ttl=0, now=lambda: HOUR + timedelta(minutes=30))
    for name, rows in (("a", [payload(1, 20), payload(2, 200), payload(3, 80)]), ("b", [payload(31, 160)])):
        put(f"{folder}/in", name, rows)
        assert start_ingest(
            stream_payloads(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/check", baselines=cache, once=True).awaitTermination(120)
    took = {r.timestamp.minute: r.stress_components_took for r in tables.read_table(spark, "records", f"{folder}/out/records").collect()}
    # Static baseline of 100 ms at first, then the median 80 ms of the first batch.
    assert took == pytest.approx({1: 0.1, 2: 1.0, 3: 0.4, 31: 1.0})


def test_catalogue_tables_take_rows_and_drop_days(spark, folder):
    put(f"{folder}/in", "a", [payload(0), payload(60 * 24 * 2), payload(60 * 24 * 5)])
    records = build_records(read_payloads(spark, f"{folder}/in"))
    tables.create_tables(spark, "kept_days", skip=("summary", "dead_letters"))
    tables.insert(records.withColumn("surplus", F.lit(1)), "kept_days", "records")
    now = HOUR + timedelta(days=5)
    assert tables.expire_partitions(spark, "kept_days", "records", now) == [date(2024, 3, 1)]
    assert tables.expire_partitions(spark, "kept_days", "records", now) == []
    assert sorted(r.day.day for r in spark.table("kept_days.records").select("day").collect()) == [3, 6]
    spark.sql("DROP DATABASE kept_days CASCADE")


def test_retention(spark, folder):
    put(f"{folder}/in", "a", [payload(0), payload(60 * 24 * 2), payload(60 * 24 * 5)])
    process_batch(read_payloads(spark, f"{folder}/in"), 0, f"{folder}/out")
    path = f"{folder}/out/records"
    now = HOUR + timedelta(days=5)
    records = tables.read_table(spark, "records", path)
    assert tables.apply_retention(records, "timestamp", 3, now).count() == 1
    assert tables.drop_expired(spark, "records", path, now) == [date(2024, 3, 1)]
    assert tables.drop_expired(spark, "records", path, now) == []
    assert tables.read_table(spark, "records", path).count() == 2
    assert tables.drop_expired(spark, "summary", f"{folder}/out/summary", now) == []
    assert tables.drop_expired(spark, "summary", f"{folder}/out/summary", now + timedelta(days=200)) == [date(2024, 3, 1)]


def test_days_are_pruned(spark, folder):
    put(f"{folder}/in", "a", [payload(0), payload(60 * 24 * 2)])
    process_batch(read_payloads(spark, f"{folder}/in"), 0, f"{folder}/out")
    records = tables.read_table(spark, "records", f"{folder}/out/records")
    found = Filters(start=datetime(2024, 3, 3), end=datetime(2024, 3, 4)).apply(records).select("stress_score")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-03-03" in plan and "request_body" not in plan
    assert found.count() == 1


def test_older_tables_read_with_defaults(spark, folder):
    put(f"{folder}/in", "a", [payload(0)])
    process_batch(read_payloads(spark, f"{folder}/in"), 0, f"{folder}/out")
    old = spark.read.parquet(f"{folder}/out/records").drop("request_bulk_doc_count", "stress_components_bulk_doc_count", "batch")
    old.write.partitionBy("day").parquet(f"{folder}/old")
    row = tables.read_table(spark, "records", f"{folder}/old").first()
    assert row.request_bulk_doc_count == 0 and row.stress_components_bulk_doc_count == 0.0


def test_align_schema_skips_and_fills(spark):
    df = spark.createDataFrame([("a", 1)], "cluster_name string, surplus int")
    row = tables.align_schema(df, RECORD, {"response_status": 5}).first()
    assert row.cluster_name == "a" and row.response_status == 5 and len(row) == len(RECORD) == 68


def test_bootstrap_is_idempotent(spark):
    first = tables.create_tables(spark, "loads", options=tables.parse_options("parquet.block.size=1048576"))
    assert first == ["database", "records", "dead_letters", "summary"]
    assert tables.create_tables(spark, "loads", skip=("database", "summary")) == ["records", "dead_letters"]
    assert spark.table("loads.records").columns == [*RECORD.names, "day"]
    spark.sql("DROP DATABASE loads CASCADE")
    with pytest.raises(ValueError):
        tables.parse_options("novalue")


def test_source_router():
    now = datetime(2024, 3, 10)
    recent, old = Filters(start=now - timedelta(days=1)), Filters(start=now - timedelta(days=30))
    by_app = ["identity_applicative_provider"]
    assert pick_source(recent, by_app, "avg", "stress_score", now) == "raw"
    assert pick_source(old, by_app, "avg", "stress_score", now) == "summary"
    assert pick_source(old, ["identity_username"], "avg", "stress_score", now) == "raw"
    assert pick_source(old, by_app, "max", "stress_score", now) == "raw"
    assert pick_source(old.drill("username", "u"), by_app, "avg", "stress_score", now) == "raw"


def test_a_range_across_the_border_counts_every_hour_once(spark):
    """Raw rows expire within an hour; the summary has that hour whole, and both know the hours after it."""
    now = datetime(2024, 3, 10, 10, 30)
    moments = [now - timedelta(minutes=37 * i) for i in range(400)]
    rows = [(m, f"op{i % 3}", 1.0 + i) for i, m in enumerate(moments)]
    raw = spark.createDataFrame(rows, "timestamp timestamp_ntz, request_operation string, stress_score double")
    hour = F.window("timestamp", "1 hour")["start"]
    summary = raw.groupBy(hour.alias("time_bucket"), "request_operation").agg(
        F.count(F.lit(1)).alias("count_state"), F.sum("stress_score").alias("sum_score_state"),
        F.struct(F.sum("stress_score").alias("sum"), F.count("stress_score").alias("n")).alias("avg_score_state"))
    left = raw.where(F.col("timestamp") >= F.lit(now - timedelta(days=3)))
    assert left.count() < raw.count()
    for start in (None, datetime(2024, 3, 5, 7), datetime(2024, 3, 9, 7, 15)):
        for op, column in (("count", None), ("sum", "stress_score"), ("avg", "stress_score")):
            for dim in (None, "request_operation"):
                got = {(r.t, r.series): r.value for r in routed_trend(left, summary, dim, op, column, Filters(start=start), now, 2).collect()}
                cells = {}
                for m, name, v in rows:
                    if start is None or m >= start:
                        cells.setdefault((m.replace(minute=0, second=0), name if dim else None), []).append(v)
                ranked = sorted({s for _, s in cells}, key=lambda s: (-sum(len(v) for (_, x), v in cells.items() if x == s), s or ""))[:2]
                fold = {"count": len, "sum": sum, "avg": lambda v: sum(v) / len(v)}[op]
                assert got == {k: pytest.approx(fold(v)) for k, v in cells.items() if k[1] in ranked}
    assert raw_since(datetime(2024, 3, 10, 10, 0)) == datetime(2024, 3, 7, 10) and raw_since(now) == datetime(2024, 3, 7, 11)
