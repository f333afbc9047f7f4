"""Substring deduplication by recompression.

A round of recompression renames runs of one symbol, then pairs of symbols from a left and a right half of the alphabet.
Names are 64-bit hashes of what they stand for, and the halves are a hash bit, so that every task of a Spark round gives
equal content the same name without a shared dictionary.  Each symbol knows which words decided on it; two equal
windows therefore hold the same symbols, but for those decided on by words outside the window.

Every window of ``window`` words is represented by its smallest such symbol (a word, if it has none).  Aggregation over
the corpus tells which representatives occur in more than one document; only windows with a shared representative go on.
They are verified as whole word sequences (128 bits of 13 words), again by aggregation: a window goes if its sequence
also starts in a document with a smaller id.

A null text has no words.  A null id counts as larger than every id, and equal to other null ids.  Rows with equal ids
do not remove each other's words.  Texts of fewer words than the window stay whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import SPACE, cut, row_key, table

LAST = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def recompress(names: np.ndarray, text: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a stream of words after some rounds: (names, words in each, first deciding word, end of deciding words).

    ``text`` numbers the text of each word, ascending.  A symbol that the edge of its text decided on has a deciding
    word outside that text.
    """
    low = np.arange(len(names))
    high = low + 1
    size = np.ones(len(names), np.int64)

    def neighbours(values, shift, edge):
        """Values of the symbols before (shift 1) or after (-1); ``edge`` where the text ends."""
        out = np.roll(values, shift)
        cut_ = np.r_[True, text[1:] != text[:-1]] if shift > 0 else np.r_[text[1:] != text[:-1], True]
        return np.where(cut_, edge, out)

    for level in range(1, rounds + 1):
        if not len(names):
            break
        # Runs.  Both neighbours are looked at to know where a run ends.
        head = np.r_[True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])]
        first = np.flatnonzero(head)
        length = np.diff(np.r_[first, len(names)])
        last = first + length - 1
        before, after = neighbours(low, 1, low - 1), neighbours(high, -1, high + 1)
        names = np.where(length > 1, mixed(names[first] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), names[first])
        low, high, text, size = before[first], after[last], text[first], np.add.reduceat(size, first)
        # Pairs of a left and a right symbol.
        left = (mixed(names + np.uint64(level)) & np.uint64(1)).astype(bool)
        joins = np.r_[left[:-1] & ~left[1:] & (text[1:] == text[:-1]), False]
        joined = np.r_[False, joins[:-1]]
        before, after = neighbours(low, 1, low - 1), neighbours(high, -1, high + 1)
        second = np.r_[names[1:], np.zeros(1, np.uint64)]
        names = np.where(joins, mixed(mixed(names) + second), names)
        new_low = np.where(~left & ~joined, before, low)
        new_high = np.where(left, after, high)
        size = size + np.where(joins, np.r_[size[1:], 0], 0)
        keep = ~joined
        names, size, low, high, text = names[keep], size[keep], new_low[keep], new_high[keep], text[keep]
    return names, size, low, high


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low:high] for each range that is not empty."""
    out = np.empty(len(low), values.dtype)
    size = np.frexp((high - low).astype(float))[1] - 1
    block = values
    for k in range(int(size.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            block = np.minimum(block[:-half], block[half:])
        at = np.flatnonzero(size == k)
        out[at] = np.minimum(block[low[at]], block[high[at] - (1 << k)])
    return out


def stretch_hashes(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of names[low:high], the same wherever these names stand."""
    step = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(step), -1, 1 << 64))
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(names), step)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(names), back)])
    total = np.r_[np.uint64(0), np.cumsum(mixed(names) * power[:-1])]
    return mixed((total[high] - total[low]) * inverse[low])


def representatives(names: np.ndarray, ends: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, representatives) of all windows in a stream of texts; ``ends`` are where the texts end."""
    sizes = np.diff(np.r_[0, ends])
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(names)) + window <= np.repeat(ends, sizes))
    out, missing = np.empty(len(starts), np.uint64), np.arange(len(starts))
    for level in range(rounds, -1, -1):
        if not len(missing):
            break
        symbols, size, low, high = recompress(names, text, level)
        # A symbol stands for all words that decided on it; long symbols go first: they are shared by chance least often.
        whole = (low >= 0) & (high <= len(names))
        content = stretch_hashes(names, np.where(whole, low, 0), np.where(whole, high, 0))
        rank = np.uint64(15) - np.minimum(size, 15).astype(np.uint64)
        values = (rank << np.uint64(60)) | (mixed(symbols + content + np.uint64(level)) >> np.uint64(4))
        wanted = starts[missing]
        from_, to = np.searchsorted(low, wanted, "left"), np.searchsorted(high, wanted + window, "right")
        some = to > from_
        out[missing[some]] = range_min(values, from_[some], to[some])
        missing = missing[~some]
    return starts, out


def sequence_hashes(names: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each window."""
    a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for j in range(window):
        word = names[starts + j]
        a = a * np.uint64(0x9E3779B97F4A7C15) + word
        b = b * np.uint64(0xC2B2AE3D27D4EB4F) + (word ^ np.uint64(0x165667B19E3779F9))
    return mixed(a), mixed(b)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = column.offsets.to_numpy()
    return values, offsets[1:] - offsets[0]


def pieces(batches, column: int, limit: int = 1 << 19):
    """Batches in parts of about ``limit`` list elements, whole rows each: bounds the memory of a task."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_names(text) -> F.Column:
    """64-bit names of the words of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def occurrences(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(name, doc): which representatives the windows of a document have.  ``docs`` has (doc, names)."""

    def run(batches):
        for batch in pieces(batches, 1):
            with np.errstate(over="ignore"):
                names, ends = flat(batch.column(1))
                starts, found = representatives(names, ends, window, rounds)
            doc = np.searchsorted(ends, starts, "right")
            new = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])][: len(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[new].view(np.int64)), batch.column(0).take(pa.array(doc[new]))], names=["name", "doc"])

    return docs.select("doc", "names").mapInArrow(run, "name long, doc long")


def candidate_windows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(h1, h2, k1, k2, place, at) of windows whose representative is among the document's ``shared`` ones."""

    def run(batches):
        for batch in pieces(batches, 3):
            with np.errstate(over="ignore"):
                names, ends = flat(batch.column(3))
                starts, found = representatives(names, ends, window, rounds)
                doc = np.searchsorted(ends, starts, "right")
                shared, shared_ends = flat(batch.column(4))
                # Names are looked up within their own document: pairs of document and name, as one sorted key each.
                known = np.unique(shared)
                pair = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, shared_ends])) * len(known) + np.searchsorted(known, shared)
                slot = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                good = (known[slot] == found) if len(known) else np.zeros(len(found), bool)
                good &= np.isin(doc * len(known) + slot, pair)
                starts, doc = starts[good], doc[good]
                h1, h2 = sequence_hashes(names, starts, window)
            take = pa.array(doc)
            at = (starts - np.r_[0, ends][doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(batch.column(i).take(take) for i in range(3)),
                 pa.array(at)], names=["h1", "h2", "k1", "k2", "place", "at"])

    return docs.select("k1", "k2", "place", "names", "shared").mapInArrow(
        run, "h1 long, h2 long, k1 long, k2 long, place long, at int")


def repeats(docs: DataFrame, id_: str, text: str, window: int = 13, rounds: int = 2) -> DataFrame:
    """(k1, k2, at): starts of windows that a document with a smaller id also has; at = -1 stands for every window."""
    k1, k2 = row_key(id_, text)
    rows = docs.select(
        k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(id_).cast("long"), F.lit(LAST)).alias("place"),
        F.col(text).alias("text"))
    # Copies of a whole text of a smaller document need no windows: all of theirs repeat.
    keys = cut(rows.select(
        "k1", "k2", "place", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")), "repeat-keys")
    firsts = keys.groupBy("t1", "t2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    firsts = cut(firsts.select("t1", "t2", "first"), "repeat-firsts")
    copies = cut(
        keys.join(firsts, ["t1", "t2"]).where("place > first").select("k1", "k2").distinct(), "repeat-copies")
    # Which representatives occur in more than one document.
    named = rows.select("k1", "k2", "place", word_names(F.col("text")).alias("names"))
    found = cut(occurrences(named.select(F.col("k1").alias("doc"), "names"), window, rounds), "repeat-names")
    shared = cut(
        found.groupBy("name").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("name"),
        "repeat-shared")
    by_doc = cut(
        found.join(shared, "name").groupBy("doc").agg(F.collect_set("name").alias("shared")), "repeat-docs")
    windows = (
        rows.join(by_doc, F.col("k1") == F.col("doc")).join(copies, ["k1", "k2"], "left_anti")
        .select("k1", "k2", "place", word_names(F.col("text")).alias("names"), "shared")
    )
    windows = cut(candidate_windows(windows, window, rounds), "repeat-windows")
    first = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    first = cut(first.select("h1", "h2", "first"), "repeat-first")
    again = windows.join(first, ["h1", "h2"]).where("place > first").select("k1", "k2", "at")
    return again.unionByName(copies.withColumn("at", F.lit(-1)))


def drop_repeats(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = 13, rounds: int = 2,
) -> DataFrame:
    """Documents (id, kept text, n_words, n_removed) without the words that repeated windows cover.

    The kept text is the kept words, joined by one space.
    """
    removed = repeats(docs, id_, text, window, rounds).groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))
    removed = cut(removed, "repeat-removed")
    k1, k2 = row_key(id_, text)
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    joined = rows.join(removed, ["k1", "k2"], "left").select("id", "text", "at")

    def run(batches):
        for batch in batches:
            texts, counts, gone = [], [], []
            for text_, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text_ or "").encode().split()
                n = len(words)
                if at and n >= window:
                    if -1 in at:
                        words = []
                    else:
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, np.asarray(at) + window, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                texts.append(b" ".join(words))
                counts.append(n)
                gone.append(n - len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
                 pa.array(gone, pa.int64())], names=["id", "text", "n_words", "n_removed"])

    kind = docs.schema[id_].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, text string, n_words long, n_removed long").select(
        F.col("id").alias(id_), F.col("text").alias(text), "n_words", "n_removed")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
