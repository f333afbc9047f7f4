"""Latency samples derived from the ``events`` table, and the two sides of a write check from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadlens.operators.latency import integrity

COLUMNS = {
    "ts": "ts",
    "path_name": "CASE WHEN user_id % 2 = 0 THEN 'gateway' ELSE 'direct' END",
    "workers": "CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 1 END",
    "op": "event_type",
    "latency_ms": "value",
    "status": "CASE WHEN value < 0.5 THEN 0 WHEN value > 100 THEN 503 WHEN value > 80 THEN 429 ELSE 200 END",
    "body": "props",
}

# What a reader finds: finished orders came through late and with another price.
READ_COLUMNS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_totalprice": "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END",
    "o_orderstatus": "o_orderstatus",
}
READ_WHERE = "o_orderstatus <> 'P'"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()])


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    written = orders.select(*READ_COLUMNS)
    read = orders.where(READ_WHERE).selectExpr(*[f"{sql} AS {name}" for name, sql in READ_COLUMNS.items()])
    return integrity(written, read, "o_orderkey")
