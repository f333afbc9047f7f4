"""Continuous ingest: payload files in, records, dead letters and summary states out.

One micro-batch is analysed once and feeds three tables, one after the other: a reader in between sees records whose
summary follows.  Each write is keyed by the batch number and replaces itself when the batch is repeated, so a restart
neither loses nor doubles rows.  Late rows need no watermark: they add one more partial state, which reading merges.
"""

from __future__ import annotations

import contextlib
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loadlens.operators.baselines import trailing_baselines
from loadlens.operators.records import analyze, split_dead_letters
from loadlens.operators.scoring import ScoringModel
from loadlens.operators.summary import summary_states
from loadlens.session import dropped_shuffles
from loadlens.sources.tables import read_table, write_table


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class BaselineCache:
    """Medians of the last hour of records, looked up again when older than ``ttl`` seconds.

    A measure without a usable median falls back to its static baseline; a failed look-up keeps the
    values in force.
    """

    path: str
    ttl: float = 60.0
    window: str = "1 hour"
    now: Callable[[], datetime] = utc_now
    clock: Callable[[], float] = time.monotonic
    values: dict[str, float | None] = field(default_factory=dict)
    read_at: float | None = None

    def current(self, spark: SparkSession) -> DataFrame | None:
        if self.read_at is None or self.clock() - self.read_at >= self.ttl:
            self.read_at = self.clock()
            try:
                self.values = self._look_up(spark)
            except PySparkException:
                pass
        if not self.values:
            return None
        one = [F.lit(value).cast("double").alias(name) for name, value in self.values.items()]
        return spark.range(1).select(*one)

    def _look_up(self, spark: SparkSession) -> dict[str, float | None]:
        moment = self.now()
        records = read_table(spark, "records", self.path)
        recent = records.where(F.col("day") >= F.date_sub(F.lit(moment.date()), 1))
        # One row: an aggregate without keys.
        return trailing_baselines(recent, moment, self.window).first().asDict()


def process_batch(
    batch: DataFrame, number: int, root: str, model: ScoringModel | None = None, baselines: DataFrame | None = None, **options
) -> None:
    analyzed = analyze(batch, model=model, baselines=baselines, **options).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        records, dead = split_dead_letters(analyzed)
        made = {"records": records, "dead_letters": dead, "summary": summary_states(records)}
        # Written as they come: a few seconds of rows are not worth a shuffle, compaction lays them out.
        for table, rows in made.items():
            write_table(rows, table, f"{root}/{table}", number, spread=False)
    finally:
        analyzed.unpersist()


def start_ingest(
    payloads: DataFrame,
    root: str,
    checkpoint: str,
    model: ScoringModel | None = None,
    baselines: BaselineCache | None = None,
    every: str = "5 seconds",
    once: bool = False,
    repeats_within: str | None = None,
    **options,
) -> StreamingQuery:
    """Run ``process_batch`` over a stream; ``once`` drains what is there and stops; ``options`` go to ``analyze``.

    ``repeats_within`` drops what a sender delivers again within that delay; the hashes it needs live in the checkpoint.
    """
    if repeats_within:
        payloads = drop_repeats(payloads, repeats_within)

    def handle(batch: DataFrame, number: int) -> None:
        current = baselines.current(batch.sparkSession) if baselines else None
        process_batch(batch, number, root, model, current, **options)

    writer = payloads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    # Whole payloads go through the shuffle that brings repeats together.
    with dropped_shuffles(payloads.sparkSession) if repeats_within else contextlib.nullcontext():
        return writer.start()


def drop_repeats(payloads: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Drop requests that a sender's retry delivered again within the delay.

    State is bounded by the watermark: one hash per request of the last ``within``.
    """
    content = F.sha2(F.concat_ws(
        "\u0001", F.col("event_time").cast("string"), "method", "path", "client_host", "request_body", "response_body"
    ), 256)
    # Watermarks need TIMESTAMP; the session zone only shifts them all alike.
    seen = F.coalesce(F.col("event_time").cast("timestamp"), F.current_timestamp())
    marked = payloads.withColumns({"__content": content, "__seen": seen}).withWatermark("__seen", within)
    return marked.dropDuplicatesWithinWatermark(["__content"]).drop("__content", "__seen")


def live_summary(records: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly counts and means per operation and cluster, for panels that follow the stream."""
    return (
        records.withColumn("__seen", F.col("timestamp").cast("timestamp")).withWatermark("__seen", late)
        .groupBy(F.window("__seen", "1 hour").alias("w"), "request_operation", "cluster_name")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("stress_score").alias("sum_score"), F.avg("stress_score").alias("avg_score"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("time_bucket"), "request_operation", "cluster_name", "count", "sum_score", "avg_score")
    )


_LIVE_KEYS = ("time_bucket", "request_operation", "cluster_name")


def start_live_summary(
    records: DataFrame, path: str, checkpoint: str, late: str = "2 hours", every: str = "5 seconds", once: bool = False,
) -> StreamingQuery:
    """Keep ``live_summary`` of a stream of records under ``path``; ``once`` drains what is there and stops.

    Hours that changed are written again with every micro-batch, each batch in a folder of its own that a repeated batch
    replaces; the state store holds hours that are still open.  A row whose hour ended more than ``late`` before the
    newest row of earlier batches is dropped.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = live_summary(records, late).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_live_summary(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every hour, closed or open."""
    found = spark.read.parquet(path)
    numbers = [c for c in found.columns if c not in (*_LIVE_KEYS, "batch")]
    latest = F.max_by(F.struct(*numbers), F.col("batch").cast("long")).alias("latest")
    return found.groupBy(*_LIVE_KEYS).agg(latest).select(*_LIVE_KEYS, "latest.*")
