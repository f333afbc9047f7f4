"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches, as the cluster names it; a temporary one in local tests only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors lose nothing.

    The shuffle files behind the table are dropped once it is written.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> list[Column]:
    """128 bits that name a row by content.  Rows equal in all these columns share it, and share every decision."""
    parts = [F.coalesce(F.xxhash64(c), F.lit(0)) for c in cols] + [F.col(c).isNull() for c in cols]
    return [F.xxhash64(F.lit("a"), *parts, *cols).alias("__k1"), F.xxhash64(F.lit("b"), *parts, *cols).alias("__k2")]


def words(text: Column) -> Column:
    """Words of a text, unchanged; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def spread_total(df: DataFrame, group: str, chunk: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Running total of ``value`` before each row, in ``order`` within ``group``, without one task per group.

    ``chunk`` must not decrease along ``order``.  Chunk totals are summed first (map-side), their running total is a
    window over one row per chunk, and rows are then summed within their own chunk only.
    """
    from pyspark.sql import Window

    rows = df.withColumn("__chunk", chunk)
    ends = (
        rows.groupBy(F.col(group).alias("__g"), F.col("__chunk").alias("__c")).agg(F.sum(value).alias("__sum"))
        .withColumn("__before", F.sum("__sum").over(
            Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)))
        .select("__g", "__c", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(group, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(ends, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__chunk") == F.col("__c")))
    total = F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return joined.withColumn(out, total).drop("__chunk", "__g", "__c", "__before")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, component) per linked node, component = smallest node.

    Each round hooks every node to its smallest neighbour, follows those parents four steps, and contracts the links.
    Nothing is collected; a node with many links is a skewed join key, which adaptive execution splits.  Rounds are
    logarithmic in the longest chain.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(links, name)
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("a"), F.min("b")).alias("p")), name + "-parent")
        for _ in range(2):
            up = parent.select(F.col("n").alias("m"), F.col("p").alias("q"))
            parent = cut(parent.join(up, F.col("p") == F.col("m")).select("n", F.col("q").alias("p")), name + "-parent")
        if labels is None:
            labels = parent.select("n", F.col("p").alias("c"))
        else:
            labels = cut(
                labels.join(parent.withColumnRenamed("n", "m"), F.col("c") == F.col("m"), "left")
                .select("n", F.coalesce("p", "c").alias("c")), name + "-labels")
        for end in ("a", "b"):
            links = links.join(parent, F.col(end) == F.col("n")).withColumn(end, F.col("p")).drop("n", "p")
        links = cut(
            links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select(F.col("n").alias("node"), F.col("c").alias("component"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
