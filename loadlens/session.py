"""Session settings the engine relies on."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession, functions as F

# Settings that change results, not speed.  Duplicate JSON keys keep the last value.
RESULT_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Run-time re-planning, on by default in Spark 4 and stated because the plans count on it (skew splits,
# small-partition merging), and the size of generated methods.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method of more bytecode than this, so a stage of many columns that is fused into one
    # would be interpreted for good; beyond the limit Spark works on the stage operator by operator, in small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session that someone else built."""
    for key, value in {**RESULT_SETTINGS, **PLAN_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "loadlens", cores: str = "*", memory: str = "8g", **extra) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by the cluster; a temporary one only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="loadlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip(os.sep)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs, or of a stream that starts, in here go once the query or micro-batch is done.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)


#: Rows of a task, at most, where a row costs far more to work on than to read.
TASK_ROWS = 100_000


def spread(df):
    """A table dealt evenly over all cores, and over more tasks as it grows.

    Building a record costs far more than reading its payload.  How many splits a table has says nothing of how
    its rows lie: a split that holds no start of a row group is empty, so a file of large row groups gives few
    tasks all the rows.  Counting reads file footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))


def held(df, *names: str):
    """``df`` with these columns worked out before any later condition on them.

    A condition on a derived column is otherwise moved below the columns it is made of, which then are worked out
    once more for every mention, in the condition and again above it.  Conditions do not pass a generator.
    """
    together = F.explode(F.array(F.struct(*names))).alias("__held")
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, together).select(*rest, *[F.col("__held")[name].alias(name) for name in names])


def built_once(build):
    """Keep the columns a function builds for as long as the Spark context lives.

    A column is only a description, valid for any frame with the names it mentions, and describing
    the record job takes Python far longer than planning it takes Spark.  Arguments are compared by
    identity.
    """
    made: dict = {}

    @functools.wraps(build)
    def columns(*args):
        context = SparkContext._active_spark_context
        key = tuple(id(arg) for arg in args)
        held = made.get(key)
        if held is None or held[0] is not context or any(a is not b for a, b in zip(held[1], args)):
            held = made[key] = (context, args, build(*args))
        return held[2]

    return columns
