"""Queries through storage: the derived log goes out as files or tables and comes back before it is asked."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.operators import summary as S
from loadlens.operators.records import analyze, build_records, split_dead_letters
from loadlens.session import configure, dropped_shuffles, shared_dir
from loadlens.schema import LATE_RECORD_COLUMNS
from loadlens.sources import tables
from loadlens.sources.payloads import explode_batches, read_payloads, stream_payloads
from loadlens.sources.request_log import request_log, time_parts
from loadlens.streaming.ingest import BaselineCache, read_live_summary, start_ingest, start_live_summary

View = Callable[[DataFrame], DataFrame]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/checks-{uuid.uuid4().hex}"


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """The request log as a sender delivers it: one JSON object per line."""
    folder = _folder(spark)
    request_log(configure(spark), sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    return folder


def scanned(view: View, **options):
    """Records of the log read back from its files."""
    return lambda spark, sf_dir: view(build_records(read_payloads(spark, _log_files(spark, sf_dir)), **options))


def streamed(table: str, view: View):
    """A table that continuous ingest filled from the files; the stream is started a second time and finds nothing new."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, root = _log_files(spark, sf_dir), _folder(spark)
        for _ in range(2):
            start_ingest(stream_payloads(spark, source), root, f"{root}/progress", once=True).awaitTermination()
        return view(tables.read_table(spark, table, f"{root}/{table}"))

    return query


#: Events of one delivery, at most: shuffles, held rows and state of a micro-batch grow with them.
DELIVERY_ROWS = 4_000_000


def delivered_twice(table: str, view: View):
    """A table filled by ingest that removes repeats, from a log whose every request was sent and sent again.

    A sender delivers in the order of time, a part of the log at a time and that part again; ingest goes on after each.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, root = _folder(spark), _folder(spark)
        for part in time_parts(configure(spark), sf_dir, DELIVERY_ROWS):
            log = request_log(spark, sf_dir, part)
            with dropped_shuffles(spark):
                for _ in range(2):
                    _deliver(log, source, compression="gzip")
            start_ingest(stream_payloads(spark, source), root, f"{root}/progress", once=True, repeats_within="1 hour").awaitTermination()
        return view(tables.read_table(spark, table, f"{root}/{table}"))

    return query


def tabled(table: str, view: View):
    """Records or dead letters after a plain write, two batches of which one is repeated, and compaction of all batches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        made = dict(zip(("records", "dead_letters"), split_dead_letters(
            analyze(request_log(configure(spark), sf_dir), decompress=False))))[table]
        thirds = F.pmod(F.xxhash64("timestamp", "request_path"), F.lit(3))
        tables.write_table(made.where(thirds == 2), table, path)
        for number in (0, 1, 1):
            tables.write_table(made.where(thirds == number), table, path, batch=number)
        tables.compact(spark, table, path, 2)
        return view(tables.read_table(spark, table, path))

    return query


def compacted_summary(view: View):
    """Summary states of two batches, the second repeated, merged by compaction."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        records = build_records(request_log(configure(spark), sf_dir), decompress=False)
        late = F.col("response_status") >= 400
        tables.write_table(S.summary_states(records.where(~late)), "summary", path, batch=0)
        for _ in range(2):
            tables.write_table(S.summary_states(records.where(late)), "summary", path, batch=1)
        tables.compact_summary(spark, path, 2)
        return view(tables.read_table(spark, "summary", path))

    return query


def _deliver(log: DataFrame, folder: str, **options) -> None:
    log.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").options(**options).text(folder)


def live(late: str):
    """Hours of a stream whose failed requests arrive after all others: those later than the watermark are dropped."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, root = _folder(spark), _folder(spark)
        log = request_log(configure(spark), sf_dir)
        failed = F.coalesce(F.col("response_status").cast("string").try_cast("bigint"), F.lit(0)) >= 400
        for part in (log.where(~failed), log.where(failed)):
            _deliver(part, source)
            records = build_records(stream_payloads(spark, source), decompress=False)
            start_live_summary(records, f"{root}/hours", f"{root}/progress", late, once=True).awaitTermination()
        return read_live_summary(spark, f"{root}/hours")

    return query


def scored_by_feedback(at, view: View):
    """Records of a stream in two deliveries; the second, from ``at`` on, is scored by medians of what the first left."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, root = _folder(spark), _folder(spark)
        log = request_log(configure(spark), sf_dir)
        before = F.col("event_time").cast("timestamp_ntz") < F.lit(at).cast("timestamp_ntz")
        for part in (log.where(before), log.where(~before)):
            _deliver(part, source)
            cache = BaselineCache(f"{root}/records", ttl=0, now=lambda: at)
            start_ingest(stream_payloads(spark, source), root, f"{root}/progress", baselines=cache, once=True).awaitTermination()
        return view(tables.read_table(spark, "records", f"{root}/records"))

    return query


def mixed_versions(view: View):
    """A table whose older batch was written before some columns existed, and whose newer one came with an unknown column."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        made = build_records(request_log(configure(spark), sf_dir), decompress=False)
        old = F.pmod(F.xxhash64("timestamp", "request_path"), F.lit(2)) == 0
        aged = tables.with_partition(made.where(old), "records").drop(*LATE_RECORD_COLUMNS)
        aged.write.partitionBy("day").parquet(f"{path}/batch=0")
        tables.write_table(made.where(~old).withColumn("not_in_schema", F.lit(1)), "records", path, batch=1, options={"compression": "snappy"})
        return view(tables.read_table(spark, "records", path).withColumn("from_old", old))

    return query


def retained(now, view: View):
    """Rows that retention leaves: whole days go first, the rest of a day is hidden on read."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        tables.write_table(build_records(request_log(configure(spark), sf_dir), decompress=False), "records", path, batch=0)
        tables.drop_expired(spark, "records", path, now)
        return view(tables.apply_retention(tables.read_table(spark, "records", path), "timestamp", tables.RAW_DAYS, now))

    return query


def catalogued(now, days: int, view: View):
    """Records in a catalogue table, the days that the catalogue says are expired dropped; made twice, which changes nothing."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        database = f"loadlens_{uuid.uuid4().hex}"
        made = build_records(request_log(configure(spark), sf_dir), decompress=False)
        for _ in range(2):
            tables.create_tables(spark, database, skip=("summary",), options=tables.parse_options("compression=zstd"))
        tables.insert(made.withColumn("not_in_schema", F.lit(1)), database, "records")
        tables.expire_partitions(spark, database, "records", now, days)
        return view(spark.table(f"{database}.records"))

    return query


def array_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation sent as a JSON array of a request, a bare string, and a request with a wrong header.

    A system turn is sent without the closing bracket, and so is no JSON at all; an assistant's is an object, not an array.
    """
    turns = configure(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    request = F.struct(F.lit("POST").alias("method"), F.concat(F.lit("/"), "role", F.lit("/_search")).alias("path"), F.col("text").alias("request_body"))
    odd = F.struct("text", F.struct(F.lit(1).alias("user-agent")).alias("headers"), F.lit("/odd").alias("path"))
    first = F.to_json(request)
    bare = F.regexp_replace(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r'^\{"t":(.*)\}$', "$1")
    value = (
        F.when(F.col("role") == "assistant", first)
        .when(F.col("role") == "system", F.concat(F.lit("["), first))
        .otherwise(F.concat(F.lit("["), F.concat_ws(",", first, bare, F.to_json(odd)), F.lit("]")))
    )
    opened = explode_batches(turns.select("conv_id", "turn", value.alias("value")))
    return opened.select("conv_id", "turn", F.col("slot").cast("int").alias("slot"), "method", "path",
                         F.md5(F.encode("request_body", "UTF-8")).alias("digest"), "scan_error")
