"""Near-duplicate documents by order MinHash.

A text is the sequence of its five-word shingles, each labelled with how often it occurred before (a text of one to four
words is one shingle).  Under each of ``sketches`` hash orders the ``kept`` smallest labelled shingles are taken in text
order; texts that agree on one such vector are candidates.  Similarity is that of the aligned sequences: m shingles
matched in order give m / (n1 + n2 - m), the order-aware form of the Jaccard index.  The alignment looks only at the band
of offsets that a similarity of ``threshold`` leaves possible, and finds the longest match there exactly.

At a similarity of 0.8 two texts agree on a vector with probability about 0.8^4, so that 32 orders miss 5 in 10^8.

Copies of a text are one node.  In each bucket of candidates only as many pairs are verified as classes need: first with
the bucket's smallest node, then, where a bucket still spans several classes, every pair of different classes, in blocks
of nodes that are compared by matrix products.  A bucket of thousands of copies of one class so costs thousands of
alignments, and no link between classes is left out.

Null texts and texts without words are in no group.  Rows equal in id and text are copies, without words too.  The class
of a group is its smallest id; null ids come last.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import components, cut, row_key, table
from loadlens.llm.substrings import LAST, flat, mixed, pieces, word_names

SHINGLE, THRESHOLD, SKETCHES, KEPT = 5, 0.8, 32, 4


def shingles(names: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of a stream of texts, and where each text's shingles end."""
    starts = np.r_[0, ends[:-1]]
    words = ends - starts
    count = np.where(words >= size, words - size + 1, (words > 0).astype(words.dtype))
    stop = np.cumsum(count)
    text = np.repeat(np.arange(len(ends)), count)
    at = np.arange(len(text)) - np.repeat(stop - count, count) + np.repeat(starts, count)
    whole = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = at + j < ends[text]
        word = names[np.where(inside, at + j, 0)]
        whole = np.where(inside, whole * np.uint64(0x9E3779B97F4A7C15) + word, whole)
    whole = mixed(whole)
    # How often a shingle occurred before in its text.
    order = np.lexsort((at, whole, text))
    new = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(order)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = np.empty(len(order), np.uint64)
    again[order] = (np.arange(len(order)) - first).astype(np.uint64)
    return mixed(whole + again * np.uint64(0xD6E8FEB86659FD93)), stop


def order_sketch(labelled: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One key per hash order: the smallest labelled shingles, in text order."""
    seeds = mixed(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flip, factor = seeds[:sketches, None], seeds[sketches:, None] | np.uint64(1)
    keys, kept = np.zeros(sketches, np.uint64), min(kept, len(labelled))
    step = max(1, (1 << 20) // len(labelled))
    for i in range(0, sketches, step):
        order = (labelled[None, :] ^ flip[i:i + step]) * factor[i:i + step]
        if kept < len(labelled):
            smallest = np.sort(np.argpartition(order, kept - 1, axis=1)[:, :kept], axis=1)
        else:
            smallest = np.tile(np.arange(kept), (len(order), 1))
        key = np.zeros(len(order), np.uint64)
        for j in range(kept):
            key = key * np.uint64(0x9E3779B97F4A7C15) + labelled[smallest[:, j]]
        keys[i:i + step] = mixed(key + flip[i:i + step, 0])
    return keys


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two sequences of labelled shingles; below the threshold perhaps less than the true one."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < threshold * (n + m - len(i)):
        return len(i) / (n + m - len(i))
    band = (n + m) * (1 - threshold) / (1 + threshold)
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near])]
    if np.all(j[1:] > j[:-1]):
        matched = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        matched = len(tails)
    return matched / (n + m - matched)


def bucket_rows(docs: DataFrame, sketches: int, kept: int) -> DataFrame:
    """(key, node) of each document's sketch; ``docs`` has (node, names)."""

    def run(batches):
        done: set[int] = set()
        for batch in pieces(batches, 1):
            names, ends = flat(batch.column(1))
            nodes = batch.column(0).to_numpy()
            keys, owners = [], []
            with np.errstate(over="ignore"):
                labelled, stop = shingles(names, ends)
                start = 0
                for node, end in zip(nodes.tolist(), stop.tolist()):
                    if end > start and node not in done:
                        done.add(node)
                        keys.append(order_sketch(labelled[start:end], sketches, kept))
                        owners.append(node)
                    start = end
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), sketches))],
                    names=["key", "node"])

    return docs.mapInArrow(run, "key long, node long")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold."""

    def run(batches):
        for batch in batches:
            kept = []
            for one in range(batch.num_rows):
                row = batch.slice(one, 1)
                with np.errstate(over="ignore"):
                    sides = [shingles(*flat(row.column(c)))[0] for c in (2, 3)]
                kept.append(aligned_similarity(*sides, threshold))
            similarity = pa.array(kept, pa.float64())
            found = pa.array(np.array(kept) >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), similarity], names=["a", "b", "similarity"]).filter(found)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", word_names(F.col("ta")), word_names(F.col("tb"))).mapInArrow(
        run, "a long, b long, similarity double")


def near_links(
    docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, sketches: int = SKETCHES, kept: int = KEPT,
) -> tuple[DataFrame, DataFrame]:
    """(verified links (a, b, similarity) between texts, components (node, component) of them).

    A text's node is its 64-bit hash.
    """
    rows = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    keys = cut(bucket_rows(rows.select("node", word_names(F.col("text")).alias("names")), sketches, kept), "near-keys")
    shared = cut(
        keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("top")).where("center < top")
        .select("key", "center"), "near-shared")
    members = cut(keys.join(shared, "key").select("key", "node", "center").distinct(), "near-members")
    texts = rows.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    texts = cut(texts, "near-texts")

    def one(pairs):
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    tried = cut(one(members.select(F.col("node").alias("a"), F.col("center").alias("b"))), "near-pairs")
    links = cut(verify(tried, texts, threshold), "near-links")
    groups = components(links.select("a", "b"), "near")

    # Buckets that still span several classes: every pair of different classes in them, block by block.
    now = members.join(groups.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("class"))
    several = now.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key")
    now = cut(now.join(several, "key"), "near-open")
    # Buckets with the same members are looked at once.
    made = now.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"))
    now = cut(now.join(made.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key"), "near-open")
    if not now.isEmpty():
        more = cut(across_classes(now, texts, threshold).distinct(), "near-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            groups = components(links.select("a", "b"), "near")
    return links, groups


def across_classes(members: DataFrame, texts: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """Links between different classes of a bucket; ``members`` has (key, node, class).

    A bucket is cut into blocks of about ``block`` nodes, large classes by themselves, and each pair of blocks that can
    hold two classes is one group.  Within it, counts of common shingles come from matrix products; they bound what an
    alignment can match, so that only pairs that may reach the threshold are aligned, and of those only the ones whose
    classes no link of the group has joined yet.
    """
    sizes = members.groupBy("key", "class").agg(F.count(F.lit(1)).alias("size"))
    pooled = sizes.groupBy("key").agg(F.sum(F.when(F.col("size") < block, F.col("size")).otherwise(0)).alias("rest"))
    sizes = cut(sizes.join(pooled, "key"), "near-sizes")
    large = F.col("size") >= block
    chunk = F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block))).otherwise(
        F.pmod(F.xxhash64("class"), F.greatest(F.ceil(F.col("rest") / block), F.lit(1))))
    placed = members.join(sizes, ["key", "class"]).select(
        "key", "node", "class", F.when(large, F.col("class")).alias("alone"), chunk.alias("chunk"))
    placed = cut(placed, "near-blocks")
    name = F.struct(F.col("alone").isNull().alias("pool"), F.coalesce("alone", F.lit(0)).alias("of"), "chunk")
    blocks = placed.select("key", name.alias("p")).distinct()
    pairs = blocks.join(blocks.withColumnRenamed("p", "q"), "key").where(
        "p < q and (p.pool or q.pool or p.of <> q.of) or p = q and p.pool")
    sequences = cut(labelled_texts(texts.join(placed.select("node").distinct(), "node", "left_semi")), "near-sequences")
    rows = placed.select("key", "node", "class", name.alias("own")).join(sequences, "node")
    first = pairs.withColumn("own", F.col("p")).join(rows, ["key", "own"]).withColumn("side", F.lit(0))
    second = pairs.where("p <> q").withColumn("own", F.col("q")).join(rows, ["key", "own"]).withColumn("side", F.lit(1))
    group = F.struct("key", "p", "q")
    both = first.unionByName(second).select(
        F.xxhash64(group).alias("group"), F.xxhash64(F.lit(1), group).alias("group2"), "side", "node", "class", "sequence")

    def compare(frame):
        left = frame[frame["side"] == 0]
        right = frame[frame["side"] == 1]
        right = right if len(right) else left
        a, b = ([np.asarray(x, np.int64).view(np.uint64) for x in side["sequence"]] for side in (left, right))
        common = common_counts(a, b)
        n, m = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
        may = common >= threshold * (n + m - common)
        may &= left["class"].to_numpy()[:, None] != right["class"].to_numpy()[None, :]
        x, y = left["node"].to_numpy(), right["node"].to_numpy()
        p, q = left["class"].to_numpy(), right["class"].to_numpy()
        found, joined = [], {}

        def top(c):
            while (up := joined.get(c, c)) != c:
                joined[c] = c = joined.get(up, up)
            return c

        for i, j in zip(*np.nonzero(may)):
            # Classes that a link has joined need no second one.
            if (one := top(p[i])) == (other := top(q[j])):
                continue
            if (similarity := aligned_similarity(a[i], b[j], threshold)) >= threshold:
                found.append((min(x[i], y[j]), max(x[i], y[j]), similarity))
                joined[max(one, other)] = min(one, other)
        return pd.DataFrame(found, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return both.groupBy("group", "group2").applyInPandas(compare, "a long, b long, similarity double")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], step: int = 1 << 13) -> np.ndarray:
    """How many labelled shingles each sequence of ``a`` shares with each of ``b``."""
    known = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for side in (a, b):
        code = np.concatenate(side)
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(known, code)
        good = (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == code) if len(known) else np.zeros(len(code), bool)
        order = np.argsort(at[good], kind="stable")
        sides.append((row[good][order], at[good][order]))
    for low in range(0, len(known), step):
        parts = []
        for (row, at), side in zip(sides, (a, b)):
            s = slice(*np.searchsorted(at, [low, low + step]))
            part = np.zeros((len(side), min(step, len(known) - low)), np.float32)
            part[row[s], at[s] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def labelled_texts(texts: DataFrame) -> DataFrame:
    """(node, sequence) of labelled shingles."""

    def run(batches):
        for batch in pieces(batches, 1):
            with np.errstate(over="ignore"):
                found, stop = shingles(*flat(batch.column(1)))
            offsets = pa.array(np.r_[0, stop].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64)))], names=["node", "sequence"])

    return texts.select("node", word_names(F.col("text")).alias("names")).mapInArrow(run, "node long, sequence array<long>")


def near_classes(docs: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: __k1, __k2 (document key), id, class (smallest id of its group), __place, __first.

    ``__first`` tells whether the row's key is the one that stays of its group.
    """
    _, groups = near_links(docs, text, **options)
    some = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = cut(docs.select(
        *row_key(id_, text), F.col(id_).alias("__id"), F.coalesce(F.col(id_).cast("long"), F.lit(LAST)).alias("__place"),
        F.when(some, F.xxhash64(text)).alias("__node")), "near-rows")
    rows = rows.join(groups, F.col("__node") == F.col("node"), "left").withColumn(
        "__class", F.coalesce("component", "__node")).drop("node", "component")
    rows = cut(rows, "near-rows")
    smallest = cut(
        rows.where(F.col("__class").isNotNull()).groupBy(F.col("__class").alias("__c"))
        .agg(F.min(F.struct("__place", "__k1", "__k2")).alias("__least"), F.count(F.lit(1)).alias("__n")), "near-smallest")
    out = rows.join(smallest.where("__n > 1"), F.col("__class") == F.col("__c"), "left")
    alone = F.col("__least").isNull()
    return out.select(
        "__k1", "__k2", F.col("__id").alias(id_),
        F.when(alone, F.col("__id")).otherwise(
            F.when(F.col("__least.__place") < LAST, F.col("__least.__place"))).alias("class"),
        (alone | (F.col("__least") == F.struct("__place", "__k1", "__k2"))).alias("__first"))


def drop_near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id."""
    first = near_classes(docs, id_, text, **options).where("__first").select("__k1", "__k2").distinct()
    first = cut(first, "near-first")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(id_, text))
    return packed.join(first, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).select("__row.*")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the class of its group, and whether it is the one that stays."""
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("class").alias("class_id"), (F.col("doc_id").eqNullSafe(F.col("class"))).alias("kept"))
