"""Turns of conversations in order, and digests of long sequences, both without one task that holds a whole group."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Turn numbers that are ranked together; a conversation of any length is ranked in pieces of this width.
RANK_SPAN = 64


def numbered(rows: DataFrame, conv: str, turn: str, ties: list[str], out: str = "__pos") -> DataFrame:
    """``rows`` with their position (from 0) in their conversation: by turn, nulls first, then by ``ties``.

    Rows are ranked within spans of turn numbers; what stands before a span is a running total over one row per span.
    ``conv`` must not be null.
    """
    span = F.coalesce(F.floor(F.col(turn) / RANK_SPAN).cast("long"), F.lit(-(2**62)))
    rows = rows.withColumn("__span", span)
    before = rows.groupBy(F.col(conv).alias("__c"), F.col("__span").alias("__s")).agg(F.count(F.lit(1)).alias("__n")).select(
        "__c", "__s", F.coalesce(F.sum("__n").over(
            Window.partitionBy("__c").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy(conv, "__span").orderBy(F.col(turn).asc_nulls_first(), *[F.col(t) for t in ties])
    ranked = rows.withColumn("__rank", F.row_number().over(within))
    return (
        ranked.join(before, (F.col(conv) == F.col("__c")) & (F.col("__span") == F.col("__s")))
        .withColumn(out, F.col("__before") + F.col("__rank") - 1).drop("__c", "__s", "__before", "__rank", "__span"))


def two_hashes(*parts: Column) -> list[Column]:
    """128 bits of content as two longs."""
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def digests(pieces: DataFrame, keys: list[str], order: list[str], piece: str, sep: str, out: str) -> DataFrame:
    """SHA-256 (lower-case hex) of all pieces of a key, in order, joined by ``sep``: one row per key.

    A digest is sequential by nature; its pieces stream through in sorted order, and only the open digest is held.
    """
    kept = StructType([pieces.schema[k] for k in keys] + [StructField(out, StringType())])

    def stream(batches):
        now, digest = None, None
        for batch in batches:
            names, found = batch.schema.names, []
            at = [names.index(k) for k in keys]
            columns = [batch.column(i).to_pylist() for i in at]
            for row, text in zip(zip(*columns), batch.column(names.index(piece)).to_pylist()):
                if row != now:
                    if digest is not None:
                        found.append((*now, digest.hexdigest()))
                    now, digest = row, hashlib.sha256()
                else:
                    digest.update(sep.encode())
                digest.update(text.encode())
            yield table(found)
        if digest is not None:
            yield table([(*now, digest.hexdigest())])

    def table(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=[*keys, out])

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [arrow[pieces.schema[k].dataType.simpleString()] for k in keys] + [pa.string()]
    narrow = pieces.select(*keys, *[c for c in order if c not in keys], piece)
    return narrow.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, kept)
