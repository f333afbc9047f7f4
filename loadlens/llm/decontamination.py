"""Benchmark decontamination by template canonicalisation.

Names (capitalised words that are no function words), numbers and units become typed placeholders, wherever they stand;
case, punctuation and the kind of white space go.  Windows of benchmark items (every position), with and without names,
meet those of documents (every ``stride``-th position) in a hash join, so that any shared run of at least
``window + stride - 1`` tokens is found.  A candidate is verified on whole token sequences, where tokens match if they are
equal or typed alike: a run must reach ``min_run`` (or the whole item).  A run of equal tokens is a leak.  In any other
run each slot value of the item must stand for one value of the document and back, which catches re-parameterised
questions and rejects chance agreement; so does the rule that a third of the run must be equal words.

Null and empty texts match nothing.  Items of fewer than ``min_item`` tokens are too short to be evidence and match
nothing; items shorter than ``window + stride - 1`` tokens are searched as one window of their own length at every
position, in the same pass over the documents.  Repeated rows are judged alike.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import SPACE, cut, row_key, table

#: Placeholders start with a letter that ordinary text does not use.
NAME, NUMBER, UNIT = "ǂa", "ǂn", "ǂu"
#: Units that may follow a number.
UNITS = ("mm|cm|m|km|in|inch|inches|ft|feet|foot|mi|mile|miles|mg|g|kg|t|lb|lbs|oz|ml|l|litre|litres|liter|liters|gal"
         "|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years"
         "|percent|dollar|dollars|euro|euros|cent|cents|mph|kmh|degrees")
#: Capitalised words that are no names.
FUNCTION_WORDS = (
    "a|an|the|this|that|these|those|some|any|each|every|all|both|no|i|you|he|she|it|we|they|his|her|its|my|your|our|their"
    "|and|or|but|if|then|so|because|while|when|where|who|whom|whose|which|what|why|how|as|than|of|in|on|at|to|from|by|with"
    "|for|about|after|before|between|into|over|under|is|are|was|were|be|been|has|have|had|do|does|did|can|could|will|would"
    "|should|may|might|must|not|there|here|now|one|two|three|four|five|six|seven|eight|nine|ten|find|given|let|suppose"
    "|el|la|los|las|un|una|y|en|de|que|le|les|des|du|et|der|die|das|ein|eine|und|mit|von|zu|ist")
#: A broadcast is used up to this many benchmark windows (24 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 2_000_000


def squeezed(text: Column) -> Column:
    """Text without punctuation, one space between tokens."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\x20\x09-\x0D]++", "")
    return F.trim(F.regexp_replace(bare, SPACE + "++", " "))


def tokens(text: Column) -> Column:
    """Tokens of squeezed text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def marked(text: Column) -> Column:
    """Squeezed text with numbers, and units behind them, as placeholders."""
    out = F.regexp_replace(text, r"[0-9]++", NUMBER)
    return F.regexp_replace(out, rf"(?<={NUMBER}\x20)(?i:{UNITS})(?!\S)", UNIT)


def unnamed(text: Column) -> Column:
    """Marked text with names as placeholders.  A capitalised word is a name wherever it stands."""
    return F.regexp_replace(text, rf"(?<!\S)(?!(?i:{FUNCTION_WORDS})(?!\S))\p{{Lu}}[\p{{L}}&&[^ǂ]]*+(?!\S)", NAME)


def with_forms(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, __t, __l, __plain): tokens of the template, of the template without names, and as they are, all as many.

    Each step is a column of its own, so that no expression of a text is evaluated twice.
    """
    df = df.withColumn("__s", squeezed(text)).select(*keep, "__s")
    df = df.select(*keep, F.lower("__s").alias("__plain"), marked(F.col("__s")).alias("__m"))
    df = df.select(*keep, "__plain", F.lower("__m").alias("__l"), F.lower(unnamed(F.col("__m"))).alias("__t"))
    return df.select(*keep, *[tokens(F.col(c)).alias(c) for c in ("__t", "__l", "__plain")])


def windows(rows: DataFrame, sizes: list[tuple[int, int, list[str]]], *keep: str) -> DataFrame:
    """(keep, __at, __h): hashes of consecutive tokens, for each (size, stride, forms); a size is part of its hash.

    Tokens are hashed once; a window hashes their hashes.
    """
    forms = list(dict.fromkeys(f for _, _, fs in sizes for f in fs))
    rows = rows.select(*keep, *[F.transform(f, lambda x: F.xxhash64(x)).alias(f) for f in forms])
    n = F.size(forms[0])

    def hashed(size, stride, used):
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_distinct(F.array(*[
            F.xxhash64(F.lit(size), F.slice(f, i + 1, F.lit(size))) for f in used])).alias("hs")))

    found = F.concat(*[hashed(*s) for s in sizes])
    each = rows.select(*keep, F.explode(found).alias("__w"))
    return each.select(*keep, F.col("__w.at").alias("__at"), F.explode("__w.hs").alias("__h"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 8, stride: int = 4, min_run: int = 13, min_item: int = 5,
) -> DataFrame:
    """One row per document and item that leaks into it.

    Columns: __k1, __k2 (document key), id, item, n_matched (template tokens in a row), n_item, same_values (no slot
    was changed).
    """
    items = benchmark.select(F.col(item).alias("__item"), F.col(item_text).alias("__text"))
    items = cut(
        with_forms(items, F.col("__text"), "__item").withColumn("__n", F.size("__t")).where(F.col("__n") >= min_item)
        .dropDuplicates(["__item", "__plain", "__t"]), "leak-items")
    keyed = docs.select(*row_key(id_, text), F.col(text).alias("__text"))
    rows = with_forms(keyed, F.col("__text"), "__k1", "__k2")
    whole = window + stride - 1
    # A unit that only one side has a number before costs a long run one token, but a whole short item its window.
    sizes = [(window, stride, ["__t", "__l"])] + [
        (r[0], 1, ["__t", "__l", "__plain"]) for r in items.where(F.col("__n") < whole).select("__n").distinct().collect()]
    wanted = None
    for size, stride_, used in sizes:
        part = items.where(F.col("__n") >= whole if stride_ == stride else F.col("__n") == size)
        part = windows(part, [(size, 1, used)], "__item", "__n")
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = cut(wanted.withColumnRenamed("__at", "__from"), "leak-windows")
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    hits = windows(rows, sizes, "__k1", "__k2").join(wanted, "__h").select(
        "__k1", "__k2", "__item", "__n", (F.col("__at") - F.col("__from")).alias("__shift")).distinct()
    hits = cut(hits, "leak-hits")
    # Texts of candidate documents only; repeated rows share a key, and one of them is enough.
    texts = (
        docs.select(*row_key(id_, text), F.col(id_).alias("__id"), F.col(text).alias("__text"))
        .join(hits.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_semi")
        .dropDuplicates(["__k1", "__k2"])
    )
    texts = with_forms(texts, F.col("__text"), "__k1", "__k2", "__id").select(
        "__k1", "__k2", "__id", F.col("__t").alias("__dt"), F.col("__plain").alias("__dp"))
    texts = cut(texts, "leak-texts")
    near = items.select(F.col("__item").alias("__i"), F.col("__n").alias("__m"), F.col("__t"), F.col("__plain"))
    pairs = hits.join(texts, ["__k1", "__k2"]).join(
        near, F.col("__item").eqNullSafe(F.col("__i")) & (F.col("__n") == F.col("__m"))).drop("__i", "__m")

    need = F.least(F.lit(min_run), F.col("__n"))
    ended = lambda acc, i: F.when(
        acc["run"] >= need, F.array_append(acc["runs"], F.struct((i - acc["run"]).alias("from"), acc["run"].alias("size")))
    ).otherwise(acc["runs"])

    def step(acc, i):
        at = i + F.col("__shift")
        typed, verbatim = F.get("__dt", at) == F.get("__t", i), F.get("__dp", at) == F.get("__plain", i)
        equal = F.coalesce(typed | verbatim, F.lit(False))
        same = F.when(F.coalesce(verbatim, F.lit(False)), acc["same"] + 1).otherwise(0)
        return F.struct(
            F.when(equal, acc["run"] + 1).otherwise(0).alias("run"),
            F.when(equal, acc["runs"]).otherwise(ended(acc, i)).alias("runs"),
            same.alias("same"), F.greatest(acc["best_same"], same).alias("best_same"))

    zero = F.struct(
        F.lit(0).alias("run"), F.array().cast("array<struct<from:int,size:int>>").alias("runs"),
        F.lit(0).alias("same"), F.lit(0).alias("best_same"))
    done = lambda acc: F.struct(ended(acc, F.col("__n")).alias("runs"), acc["best_same"].alias("best_same"))
    pairs = pairs.withColumn("__run", F.aggregate(F.sequence(F.lit(0), F.col("__n") - 1), zero, step, done))
    pairs = pairs.where(F.size("__run.runs") > 0)

    def judged(run):
        inside = F.sequence(run["from"], run["from"] + run["size"] - 1)
        there = lambda name, i: F.get(name, i + F.col("__shift"))
        slots = F.transform(
            F.filter(inside, lambda i: F.get("__t", i).contains("ǂ") & (there("__dt", i) == F.get("__t", i))),
            lambda i: F.struct(F.get("__t", i).alias("kind"), F.get("__plain", i).alias("mine"),
                               there("__dp", i).alias("theirs")))
        literal = F.size(F.filter(inside, lambda i: F.get("__plain", i) == there("__dp", i)))
        return F.struct(run["size"].alias("size"), F.array_distinct(slots).alias("slots"), literal.alias("literal"))

    def holds(run):
        side = lambda name: F.size(F.array_distinct(F.transform(
            run["slots"], lambda s: F.struct(s["kind"], s[name]))))
        # Titles and tables are all names or numbers; without a third of equal words only equal texts are evidence.
        return (F.size(run["slots"]) == side("mine")) & (F.size(run["slots"]) == side("theirs")) & (
            run["literal"] * 3 >= run["size"])

    found = lambda size, same: F.struct(
        size.alias("n_matched"), F.col("__n").alias("n_item"), same.alias("same_values"))
    pairs = pairs.withColumn("__judged", F.transform("__run.runs", judged))
    runs = F.transform(F.filter("__judged", holds), lambda r: found(
        r["size"], ~F.exists(r["slots"], lambda s: s["mine"] != s["theirs"])))
    # A long enough run of equal tokens is a leak, whatever was changed beside it.
    equal_run = F.when(F.col("__run.best_same") >= need, found(F.col("__run.best_same"), F.lit(True)))
    pairs = pairs.withColumn("__best", F.array_max(F.array_append(runs, equal_run))).where(F.col("__best").isNotNull())
    return pairs.groupBy("__k1", "__k2", "__item").agg(
        F.first("__id").alias(id_), F.max("__best").alias("__best"),
    ).select("__k1", "__k2", id_, F.col("__item").alias(item), "__best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that an item leaks into."""
    leaks = cut(find_leaks(docs, benchmark, id_, text, **options).select("__k1", "__k2").distinct(), "leaks")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(id_, text))
    return packed.join(leaks, ["__k1", "__k2"], "left_anti").select("__row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked document and item: tokens in a row, tokens of the item, whether all slot values are the item's."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_matched", "n_item", "same_values")
