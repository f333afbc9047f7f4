"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents are shuffled and laid on a token line, which is cut into blocks of ``block_tokens``.  A source with
target T gets ceil(T / block) slots.  Slot times come from the van der Corput sequence: time i has the point
reverse_bits(i) / 2^m, and that point, through the cumulative slot counts, names the source.  The r-th slot of a source
takes its r-th block; the line starts anew where it ends, and the last block is cut at the target, so that the words
taken equal the rounded target.

Null or empty texts have size 0 and are never taken.  A null source is a source of its own, ordered last.  Rows that are
repeated are separate documents.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import WORD, cut, spread_total, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sized: DataFrame, share: float = 1.5, limit: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source: size, weight, target.

    Targets are min(limit * size, level * weight).  Sources are sorted by the level at which they reach their limit;
    the level is found from running sums, which is what resharing the excess ends at.
    """
    by_source = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    ordered = Window.orderBy(F.col("__source").asc_nulls_last())
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("__place", place).withColumn("__weight", weight)
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(float(limit)))
    up = Window.orderBy(F.col("__cap") / F.col("__weight"), "__place")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("__full", F.coalesce(F.sum("__cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__rest", F.sum("__weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    level = (F.col("__total") - F.col("__full")) / F.col("__rest")
    rows = rows.withColumn(
        "__level", F.max(F.when(level <= F.col("__cap") / F.col("__weight"), level)).over(everything))
    over = F.col("__level").isNull() | (F.col("__cap") <= F.col("__level") * F.col("__weight"))
    return rows.select(
        "__source", "__place", "source_size",
        F.when(over, F.col("__cap")).otherwise(F.col("__level") * F.col("__weight")).alias("target"))


def reversed_bits(i, bits: int):
    """The low ``bits`` bits of a long in reverse order."""
    steps = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
             (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))
    for shift, mask in steps:
        low = F.shiftleft(i.bitwiseAND(F.lit(mask)), shift)
        high = F.shiftrightunsigned(i, shift).bitwiseAND(F.lit(mask))
        i = low.bitwiseOR(high)
    i = F.shiftleft(i, 32).bitwiseOR(F.shiftrightunsigned(i, 32))
    return F.shiftrightunsigned(i, 64 - bits)


def schedule(spark: SparkSession, targets: DataFrame, block_tokens: int, bin_bits: int = 10, chunk_bits: int = 12) -> DataFrame:
    """Slots (slot, __place, rank): which source a slot takes from, and the how-manieth slot of that source it is."""
    quota = F.ceil(F.round("target") / block_tokens).cast("long")
    line = Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        targets.select("__place", quota.alias("__quota"))
        .withColumn("__from", F.coalesce(F.sum("__quota").over(line), F.lit(0)))
        .withColumn("__to", F.col("__from") + F.col("__quota")).where("__quota > 0")
    )
    n = quotas.agg(F.max("__to")).first()[0] or 0
    bits = max(1, (max(n, 1) - 1).bit_length())
    points = spark.range(1 << bits).withColumn("__point", reversed_bits(F.col("id"), bits)).where(F.col("__point") < n)
    # Cumulative weights as a join: a source is listed under each bin of points that it touches.
    bins = quotas.withColumn("__bin", F.explode(F.sequence(
        F.shiftright("__from", bin_bits), F.shiftright(F.col("__to") - 1, bin_bits))))
    slots = (
        points.withColumn("__bin", F.shiftright("__point", bin_bits)).join(bins, "__bin")
        .where("__point >= __from and __point < __to")
        .select(F.col("id").alias("slot"), "__place", F.lit(1).alias("__one"))
    )
    return spread_total(
        slots, "__place", F.shiftright("slot", chunk_bits), [F.col("slot")], "__one", "rank"
    ).select("slot", "__place", "rank")


def mix(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = 256,
    share: float = 1.5, limit: float = 2.0, shuffle_bins: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target and taken; the schedule's pieces).

    A piece (slot, source, id, from_word, to_word) tells which words of a document a slot takes.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(
        F.col(id_).alias("__id"), F.col(source).alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("__size")), "mix-sizes")
    targets = cut(source_targets(sized, share, limit), "mix-targets")
    known = sized.join(targets, sized["__source"].eqNullSafe(targets["__source"])).drop(targets["__source"])
    # Shuffled order: by a hash of the id, so that reruns agree.
    order = F.xxhash64(F.lit("order"), F.col("__id"))
    full = known.where("__size > 0").withColumn("__order", order)
    lined = spread_total(
        full, "__place", F.shiftrightunsigned("__order", 64 - (shuffle_bins - 1).bit_length()),
        [F.shiftrightunsigned("__order", 1), F.col("__id"), F.col("__size")], "__size", "__at")
    block = F.lit(block_tokens)
    placed = (
        lined.withColumn("__pass", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("__start", F.col("__at") + F.col("__pass") * F.col("source_size"))
        .withColumn("__end", F.least(F.col("__start") + F.col("__size"), F.round("target").cast("long")))
        .where("__start < __end")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__end") - 1) / block))))
    )
    slots = schedule(spark, targets, block_tokens)
    pieces = placed.join(slots, ["__place", "rank"]).select(
        "slot", "__source", "__id", "__place", "__size", "__at",
        (F.greatest("__start", F.col("rank") * block) - F.col("__start")).alias("from_word"),
        (F.least("__end", (F.col("rank") + 1) * block) - F.col("__start")).alias("to_word"))
    pieces = cut(pieces, "mix-pieces")
    # A document is named by its place on the line, which repeated rows do not share.
    taken = pieces.groupBy("__place", "__at").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    lined = lined.join(taken, ["__place", "__at"], "left").select(
        "__id", "__source", "__size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = known.where("__size = 0").select(
        "__id", "__source", "__size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    result = lined.unionByName(empty).select(
        F.col("__id").alias(id_), F.col("__source").alias(source), F.col("__size").alias("size"), "source_size", "target",
        F.col("taken").cast("long").alias("taken"))
    return result, pieces.select(
        "slot", F.col("__source").alias(source), F.col("__id").alias(id_), "from_word", "to_word")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
