"""Tables: records and dead letters by day, summary states by month.

A batch is a folder, ``batch=<number>/<partition>``, written by Spark's plain overwrite: a repeated batch takes its own
place, whatever day its rows lie on.  While it does, readers may miss that batch.  Writes without a number get a folder of
their own.  Compaction joins batches that are closed - below the number that the stream has committed, so never written
again - into ``batch=<first>-<last>``.  That name says what it stands for: once the folder is complete, readers pass over
the batches it covers, so nothing counts twice whether or not those are deleted yet, and writing a covered batch is an error.

Writes are laid out for the panels: a rebalance by day, cluster and operation gives even files (AQE
splits a combination that holds a third of all rows), and rows are sorted inside each file so that
row-group statistics skip what a filter does not touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loadlens.operators.summary import merge_states
from loadlens.schema import DEAD_LETTER, LATE_RECORD_COLUMNS, RECORD, SUMMARY

# Days to keep.
RAW_DAYS = 3
SUMMARY_DAYS = 120

# Table -> (schema, time column, partition column, sort columns).
LAYOUT = {
    "records": (RECORD, "timestamp", "day",
                ("cluster_name", "request_operation", "identity_applicative_provider", "timestamp")),
    "dead_letters": (DEAD_LETTER, "timestamp", "day", ("cluster_name", "timestamp")),
    "summary": (SUMMARY, "time_bucket", "month", tuple(SUMMARY.names[:6])),
}
_SPREAD_BY = {
    "records": ("cluster_name", "request_operation"), "dead_letters": ("cluster_name",), "summary": ("cluster_name", "request_operation"),
}


def parse_options(text: str) -> dict[str, str]:
    """'k1=v1,k2=v2' as a dict of writer options."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, found, value = part.partition("=")
        if not found:
            raise ValueError(f"expected name=value, got {part!r}")
        out[name.strip()] = value.strip()
    return out


def with_partition(df: DataFrame, table: str) -> DataFrame:
    _, ts, column, _ = LAYOUT[table]
    moment = F.col(ts).cast("date")
    return df.withColumn(column, F.trunc(moment, "month") if column == "month" else moment)


def align_schema(df: DataFrame, schema: T.StructType, defaults: Mapping | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: unknown ones dropped, missing ones filled."""
    defaults = defaults or {}

    def column(field: T.StructField):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


# -- batches --------------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at(path))] if fs.exists(at(path)) else []


def _batches(spark: SparkSession, path: str) -> tuple[dict[str, tuple[int, int]], set[str]]:
    """(numbered batches in force with the numbers they hold, batches that are covered or unfinished)."""
    fs, at = _files(spark, path)
    spans, hidden = {}, set()
    for name in _names(spark, path):
        kind, _, value = name.partition("=")
        first, dash, last = value.partition("-")
        if kind != "batch" or not first.isdigit():
            continue
        if dash and not fs.exists(at(f"{path}/{name}/_SUCCESS")):
            hidden.add(value)
        else:
            spans[value] = (int(first), int(last or first))
    joined = [(lo, hi, v) for v, (lo, hi) in spans.items() if "-" in v]
    hidden |= {v for v, (lo, hi) in spans.items() if any(a <= lo and hi <= b and v != w for a, b, w in joined)}
    return {v: span for v, span in spans.items() if v not in hidden}, hidden


def closed_batches(spark: SparkSession, checkpoint: str) -> int:
    """Number below which a stream writes no batch again: one above its last commit, 0 before the first."""
    return max((int(n) + 1 for n in _names(spark, f"{checkpoint}/commits") if n.isdigit()), default=0)


def write_table(
    df: DataFrame, table: str, path: str, batch: int | None = None, options: Mapping[str, str] | None = None, spread: bool = True,
) -> None:
    """Append rows; with a ``batch`` number, writing the same batch again replaces what it wrote before.

    ``spread=False`` writes rows as they come; compaction lays them out.
    """
    if batch is not None:
        lo_hi = [span for value, span in _batches(df.sparkSession, path)[0].items() if "-" in value]
        if any(lo <= batch <= hi for lo, hi in lo_hi):
            raise ValueError(f"batch {batch} of {path} is closed and compacted")
    _write(df, table, f"{path}/batch={uuid.uuid4().hex + 'w' if batch is None else batch}", options, spread)


def _write(df: DataFrame, table: str, folder: str, options: Mapping[str, str] | None = None, spread: bool = True) -> None:
    schema, _, column, order = LAYOUT[table]
    rows = with_partition(align_schema(df, schema), table)
    if spread:
        rows = rows.hint("rebalance", column, *_SPREAD_BY[table]).sortWithinPartitions(column, *order)
    rows.write.mode("overwrite").options(**{"compression": "zstd", **(options or {})}).partitionBy(column).parquet(folder)


def _read(spark: SparkSession, table: str, path: str) -> DataFrame:
    schema, _, column, _ = LAYOUT[table]
    stored = T.StructType([*schema.fields, T.StructField(column, T.DateType())])
    nested = any(n.startswith("batch=") for n in _names(spark, path))
    found = spark.read.schema(T.StructType([*stored.fields, T.StructField("batch", T.StringType())]) if nested else stored).parquet(path)
    if table != "records":
        return found
    late = {name: F.coalesce(F.col(name), F.lit(value).cast(schema[name].dataType)) for name, value in LATE_RECORD_COLUMNS.items()}
    return found.withColumns(late)


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Rows in force with their partition column; columns that older files lack read as their default.

    A folder without batches is read as it lies.
    """
    _, hidden = _batches(spark, path)
    rows = _read(spark, table, path)
    if hidden:
        rows = rows.where(~F.col("batch").isin(*sorted(hidden)))
    return rows.select(*LAYOUT[table][0].names, LAYOUT[table][2])


# -- retention ------------------------------------------------------------------------------

def apply_retention(df: DataFrame, ts: str, days: int, now: datetime) -> DataFrame:
    """Rows younger than ``days``."""
    return df.where(F.col(ts) > F.lit(now - timedelta(days=days)).cast("timestamp_ntz"))


def _end(start: date, column: str) -> date:
    if column == "day":
        return start + timedelta(days=1)
    return (start.replace(day=28) + timedelta(days=4)).replace(day=1)


def drop_expired(spark: SparkSession, table: str, path: str, now: datetime, days: int | None = None) -> list[date]:
    """Delete partitions whose every row is older than the retention; returns what was deleted.

    Whole partitions go, by the names of their folders alone; rows of a partly expired one stay until it is complete,
    ``apply_retention`` hides them on read.
    """
    column = LAYOUT[table][2]
    limit = now - timedelta(days=days if days is not None else SUMMARY_DAYS if table == "summary" else RAW_DAYS)
    fs, at = _files(spark, path)
    gone = set()
    for status in fs.globStatus(at(f"{path}/batch=*/{column}=*")) or []:
        value = status.getPath().getName().partition("=")[2]
        if "__HIVE" in value:
            continue
        start = date.fromisoformat(value)
        if datetime.combine(_end(start, column), datetime.min.time()) <= limit:
            fs.delete(status.getPath(), True)
            gone.add(start)
    return sorted(gone)


def compact(spark: SparkSession, table: str, path: str, closed: int, again: bool = False) -> str | None:
    """Join the closed batches that no compaction has joined yet into one; returns its name, None if there is nothing to do.

    ``closed`` is the number below which no batch is written again (``closed_batches``); later ones are left alone, as is
    what lands meanwhile.  Summary states merge per key, other rows are laid out anew.  ``again`` takes earlier
    compactions in as well.  Covered batches are deleted at the end; what a lost run leaves of them is hidden from
    readers and deleted by the next.  Run one compaction of a table at a time.
    """
    live, hidden = _batches(spark, path)
    taken = {v: span for v, span in live.items() if span[1] < closed and (again or "-" not in v)}
    made = None
    if len(taken) > 1:
        made = f"{min(lo for lo, _ in taken.values())}-{max(hi for _, hi in taken.values())}"
        rows = _read(spark, table, path).where(F.col("batch").isin(*sorted(taken))).drop("batch")
        _write(merge_states(rows) if table == "summary" else rows, table, f"{path}/batch={made}")
        hidden |= set(taken)
    fs, at = _files(spark, path)
    for value in hidden - {made}:
        fs.delete(at(f"{path}/batch={value}"), True)
    return made


def compact_summary(spark: SparkSession, path: str, closed: int) -> str | None:
    """Merge the partial states of all closed batches into one row per key."""
    return compact(spark, "summary", path, closed, again=True)


# -- catalog tables -------------------------------------------------------------------------

def insert(df: DataFrame, database: str, table: str) -> None:
    """Append to a catalogue table: columns by name, unknown ones dropped, missing ones NULL."""
    rows = with_partition(align_schema(df, LAYOUT[table][0]), table)
    name = f"{database}.{table}"
    rows.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def expire_partitions(spark: SparkSession, database: str, table: str, now: datetime, days: int | None = None) -> list[date]:
    """Drop partitions of a catalogue table whose every row is older than the retention, by the catalogue alone."""
    column = LAYOUT[table][2]
    limit = now - timedelta(days=days if days is not None else SUMMARY_DAYS if table == "summary" else RAW_DAYS)
    gone = []
    # One row a partition: days or months.
    for row in spark.sql(f"SHOW PARTITIONS {database}.{table}").collect():
        value = row["partition"].partition("=")[2]
        if "__HIVE" in value:
            continue
        start = date.fromisoformat(value)
        if datetime.combine(_end(start, column), datetime.min.time()) <= limit:
            spark.sql(f"ALTER TABLE {database}.{table} DROP IF EXISTS PARTITION ({column} = DATE '{value}')")
            gone.append(start)
    return sorted(gone)


def create_tables(
    spark: SparkSession, database: str, skip: Sequence[str] = (), options: Mapping[str, str] | None = None
) -> list[str]:
    """Create database and tables that do not exist, add columns that older tables lack; returns what was run."""
    done = []

    def run(name: str, statement: str) -> None:
        spark.sql(statement)
        done.append(name)

    if "database" not in skip:
        run("database", f"CREATE DATABASE IF NOT EXISTS {database}")
    properties = {"compression": "zstd", **(options or {})}
    rendered = ", ".join(f"'{name}' = '{value}'" for name, value in properties.items())
    for table, (schema, _, column, _) in LAYOUT.items():
        if table in skip:
            continue
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        run(table, f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}, {column} DATE) USING parquet "
                   f"OPTIONS ({rendered}) PARTITIONED BY ({column})")
        have = set(spark.table(f"{database}.{table}").columns)
        lacking = [f for f in schema.fields if f.name not in have]
        if lacking:
            added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lacking)
            run(f"{table}_columns", f"ALTER TABLE {database}.{table} ADD COLUMNS ({added})")
    return done
