"""Context-tree weighting: the code length of a text under a mixture of all context depths.

A byte is eight binary decisions.  Every decision, named by the bits of the byte so far, has a tree of contexts: the last
0 .. ``depth`` bytes.  A node estimates by Krichevsky and Trofimov, (count + 1/2) / (total + 1); its weighted probability is
half its own estimate of what was counted there and half the product of its children's.  Frozen after training, that gives
each node the share it has against its children, and a bit's probability mixes the estimates along its context by them.

1. One pass over the texts cuts them into chunks of some megabytes and counts, per chunk, its distinct (context, byte) grams
   and words.  Texts of held-out documents add their grams with a count of zero, so that every gram asked for is known.
2. Counts are summed over all chunks.  The trees are aggregations: each depth sums the counts and log-probabilities of the
   depth below it, and shares are handed down by a join per depth.  Each gram so gets one log-probability.
3. Each chunk gets back the values of its own grams and words, and sums them over its texts.  No task holds the model.

Texts have A-Z in lower case; ``depth`` zero bytes stand before them and one zero byte, which is scored, ends them.  The base
score is that of add-one word counts.  Nulls are empty texts; an empty text scores its end.  A row with a null id is trained
on.  Repeated rows count and are scored each.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType)

from loadlens.llm.common import cut, discard, table

#: Bytes of context.
DEPTH = 5
#: Bytes of text whose grams are counted together, and grams that one numpy call works on.
CHUNK_BYTES = 32 << 20
PIECE = 1 << 20
#: Rows of grams and words that are handed to Spark at a time.
ROWS = 1 << 16
DOCS, GRAMS, WORDS = range(3)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---- in tasks: texts to grams and words ------------------------------------------------------------------------------

def give_back() -> None:
    """Freed memory goes back to the system, not to a pool: two workers share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lower(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts with A-Z in lower case, their bytes, and where each begins and ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    small, ends = LOWER[raw[ends[0]:ends[-1]]], ends - ends[0]
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(small))
    return made, small, ends


def gram_pieces(data: np.ndarray, ends: np.ndarray, depth: int):
    """(grams, their text, where each text begins among them), piece by piece; a long text spans several pieces."""
    parts, size = [], 0
    for i in range(len(ends) - 1):
        a, end = int(ends[i]), int(ends[i + 1])
        while True:
            b = min(end, a + PIECE - size)
            parts.append((i, a, b, b == end, int(ends[i])))
            size += b - a + depth
            if size >= PIECE:
                yield _grams(data, parts, depth)
                parts, size = [], 0
            if b == end:
                break
            a = b
    if parts:
        yield _grams(data, parts, depth)


def _grams(data: np.ndarray, parts: list[tuple], depth: int):
    lengths = np.array([b - a + last for _, a, b, last, _ in parts], np.int64)
    buffer = np.zeros(int(lengths.sum()) + depth * len(parts), np.uint8)
    keep = np.ones(len(buffer), bool)
    at = 0
    for (_, a, b, last, begin), n in zip(parts, lengths):
        before = min(depth, a - begin)
        buffer[at + depth - before:at + depth + b - a] = data[a - before:b]
        keep[at:at + depth] = False
        at += depth + int(n)
    keys = np.zeros(len(buffer) - depth, np.int64)
    for j in range(depth + 1):
        keys <<= 8
        keys |= buffer[j:len(buffer) - depth + j]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    full = lengths > 0
    return keys[keep[depth:]], np.array([p[0] for p in parts])[full], starts[full], lengths[full]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in turn, and the text of each."""
    lists = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    full = pc.not_equal(words, pa.scalar("", words.type))
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def _cuts(sizes: np.ndarray, most: int):
    """Runs of texts of about ``most`` bytes."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def chunker(schema: pa.Schema, depth: int):
    """Per chunk: one row of its texts, and rows of its distinct grams and words with their counts in training texts."""
    def chunks(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for begin, end in _cuts(sizes, CHUNK_BYTES):
                yield from one(batch.slice(begin, end - begin))

    def one(batch):
        chunk = uuid.uuid4().int >> 65
        train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        texts, data, ends = lower(batch.column(2))
        fields = {"ids": batch.column(0), "held": batch.column(1), "sizes": pa.array(np.diff(ends))}
        yield rows(chunk, DOCS, 1, data=pa.array([pa.compress(pa.py_buffer(data), "zstd", asbytes=True)]), **{
            k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in fields.items()})
        found, size, most = [], 0, 2 * PIECE
        for keys, owner, _, lengths in gram_pieces(data, ends, depth):
            piece = pc.dictionary_encode(pa.array(keys))
            index = piece.indices.to_numpy()[np.repeat(train[owner], lengths)]
            found.append((piece.dictionary.to_numpy(), np.bincount(index, minlength=len(piece.dictionary))))
            size += len(found[-1][0])
            if size > most:
                found = [merged(found)]
                size = len(found[0][0])
                most = size + 2 * PIECE
        grams, times = merged(found)
        order = np.argsort(grams)
        grams, times = grams[order], times[order]
        del found, order
        give_back()
        yield from batches_of(chunk, GRAMS, gram=pa.array(grams), n=pa.array(times))
        del grams, times
        words, counts, _ = counted_words(texts, train)
        yield from batches_of(chunk, WORDS, word=words, at=pa.array(np.arange(len(words))), n=pa.array(counts))
        del words, counts, texts, data
        give_back()

    def merged(found):
        once = pc.dictionary_encode(pa.array(np.concatenate([f[0] for f in found])))
        times = np.bincount(once.indices.to_numpy(), np.concatenate([f[1] for f in found]), len(once.dictionary))
        return once.dictionary.to_numpy(), times.astype(np.int64)

    def batches_of(chunk, kind, **columns):
        # Millions of rows in one batch would lie in the worker and, once more, in the executor's own memory.
        for begin in range(0, len(columns["n"]), ROWS):
            part = {name: column.slice(begin, ROWS) for name, column in columns.items()}
            yield rows(chunk, kind, len(part["n"]), **part)

    def rows(chunk, kind, size, **columns):
        values = {"chunk": pa.array(np.full(size, chunk, np.int64)), "kind": pa.array(np.full(size, kind, np.int64))} | columns
        return pa.RecordBatch.from_arrays(
            [values[f.name].cast(f.type) if f.name in values else pa.nulls(size, f.type) for f in schema], schema=schema)

    return chunks


def counted_words(texts: pa.Array, train: np.ndarray):
    """Distinct words in the order of their first place, their counts in training texts, and pieces: indices, first text, words by text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    listed, pieces = [], []
    for begin, end in _cuts(sizes, PIECE):
        words, owner = split_words(texts.slice(begin, end - begin))
        found = pc.dictionary_encode(words)
        listed.append(found.dictionary)
        pieces.append((found.indices.to_numpy(zero_copy_only=False), begin, np.bincount(owner, minlength=end - begin)))
    found = pc.dictionary_encode(pa.concat_arrays(listed))
    place, at = found.indices.to_numpy(zero_copy_only=False), 0
    counts = np.zeros(len(found.dictionary), np.int64)
    for i, (index, begin, each) in enumerate(pieces):
        pieces[i] = place[at:at + len(listed[i])][index], begin, each
        at += len(listed[i])
        used = np.repeat(train[begin:begin + len(each)], each)
        counts += np.bincount(pieces[i][0][used], minlength=len(counts))
    return found.dictionary, counts, pieces


def scorer(depth: int, tokens: int, kinds: int, trained: int, schema: pa.Schema):
    """Scores of the texts of one chunk from the values of its grams and the counts of its words."""
    def score(docs: pa.Table, values: pa.Table) -> pa.Table:
        parts = [one(row, values) for row in docs.to_pylist()]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    def one(row, values):
        give_back()
        size = np.array(row["sizes"], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(pa.decompress(row["data"], int(ends[-1]), "zstd", asbytes=True), np.uint8)
        texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data))
        held, n = np.array(row["held"], bool), len(size)
        of_word = pc.is_valid(values.column("at"))
        grams, words = values.filter(pc.invert(of_word)), values.filter(of_word)
        known, price = grams.column("gram").to_numpy(), grams.column("value").to_numpy()
        order = np.argsort(known)
        known, price = known[order], price[order]
        del grams, order
        total = np.zeros(n)
        for keys, owner, starts, _ in gram_pieces(data, ends, depth):
            found = pc.dictionary_encode(pa.array(keys))
            each = price[np.searchsorted(known, found.dictionary.to_numpy())][found.indices.to_numpy()]
            np.add.at(total, owner, np.add.reduceat(each, starts))
        del known, price
        give_back()
        _, times, pieces = counted_words(texts, ~held)
        times[words.column("at").to_numpy()] = words.column("value").to_numpy().astype(np.int64)
        price, tokens_, known_words = np.log10((times + 1) / (tokens + kinds + 1)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        base = np.full(n, math.log10((trained + 1) / (tokens + kinds + 1)))
        for index, begin, each in pieces:
            owner = np.repeat(np.arange(begin, begin + len(each)), each)
            tokens_ += np.bincount(owner, minlength=n)
            known_words += np.bincount(owner[times[index] > 0], minlength=n)
            base += np.bincount(owner, price[index], n)
        return pa.table([
            pa.array(row["ids"], schema.field("id").type), pa.array(held), pa.array(tokens_ + 1),
            pa.array(known_words + (trained > 0)), pa.array(np.full(n, tokens)), pa.array(base), pa.array(total), pa.array(size),
            pa.array(-total * math.log2(10) / (size + 1))], names=schema.names).cast(schema)

    return score


# ---- on Spark: the trees ---------------------------------------------------------------------------------------------

def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2, to about 1e-11: Stirling's series eight steps up."""
    z, product = x + 8, x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.cast("double"), b.cast("double")
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def decisions(grams: DataFrame) -> DataFrame:
    """Eight rows per gram: its context, the decision (1 and the bits so far) and the bit."""
    byte = F.col("gram").bitwiseAND(255).cast("int")
    each = [F.struct(
        (F.lit(1 << i) + F.shiftright(byte, 8 - i)).alias("node"),
        F.shiftright(byte, 7 - i).bitwiseAND(1).alias("bit")) for i in range(8)]
    return grams.select("*", F.shiftright("gram", 8).alias("context"), F.explode(F.array(*each)).alias("e")).select(
        *grams.columns, "context", "e.*")


def gram_values(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """log10 probability of each gram (gram, n): of its last byte behind the ``depth`` bytes before it."""
    held = cut(decisions(grams).groupBy("context", "node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("b"))
        .withColumn("own", kt(F.col("a"), F.col("b"))).withColumn("weighted", F.col("own")).withColumn("under", F.lit(0.0)), "ctw-level")
    levels = [held]
    for d in range(depth - 1, -1, -1):
        level = levels[-1].groupBy(F.col("context").bitwiseAND(256 ** d - 1).alias("context"), "node").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("under")).withColumn("own", kt(F.col("a"), F.col("b")))
        high, low = F.greatest("own", "under"), F.least("own", "under")
        levels.append(cut(level.withColumn("weighted", high + F.log1p(F.exp(low - high)) - math.log(2)), "ctw-level"))
    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    share = 1 / (1 + F.exp(F.col("under") - F.col("own")))
    above = None
    for d, level in enumerate(reversed(levels)):
        share_ = share if d < depth else F.lit(1.0)
        here = level.select("context", "node", one.alias("one"), share_.alias("share"))
        if above is None:
            above = here.select("context", "node", (F.col("share") * F.col("one")).alias("mix"), (1 - F.col("share")).alias("rest"))
            continue
        above = above.withColumnRenamed("context", "up")
        here = here.withColumn("up", F.col("context").bitwiseAND(256 ** (d - 1) - 1))
        above = here.join(above, ["up", "node"]).select(
            "context", "node", (F.col("mix") + F.col("rest") * F.col("share") * F.col("one")).alias("mix"),
            (F.col("rest") * (1 - F.col("share"))).alias("rest"))
    chances = cut(above, "ctw-chances")
    discard(*levels)
    chance = F.when(F.col("bit") == 1, F.col("mix")).otherwise(1 - F.col("mix"))
    return decisions(grams.select("gram")).join(chances, ["context", "node"]).groupBy("gram").agg(F.sum(F.log10(chance)).alias("value"))


def score_texts(docs: DataFrame, id_: str = "doc_id", text: str = "text", held: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: id, held, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows for which ``held`` is true are scored but not learned from.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6 bytes")
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    id_type = docs.schema[id_].dataType
    fields = StructType([
        StructField("chunk", LongType()), StructField("kind", LongType()), StructField("ids", ArrayType(id_type)),
        StructField("held", ArrayType(BooleanType())), StructField("sizes", ArrayType(LongType())), StructField("data", BinaryType()),
        StructField("gram", LongType()), StructField("word", StringType()), StructField("at", LongType()), StructField("n", LongType())])
    rows = docs.select(F.col(id_).alias("id"), held.alias("held"), F.col(text).alias("text"))
    parts = cut(rows.mapInArrow(chunker(to_arrow_schema(fields), depth), fields), "ctw-parts")
    texts = parts.where(F.col("kind") == DOCS).select("chunk", "ids", "held", "sizes", "data")
    chunk_grams = parts.where(F.col("kind") == GRAMS).select(F.col("chunk").alias("part"), "gram", "n")
    chunk_words = parts.where(F.col("kind") == WORDS).select(F.col("chunk").alias("part"), "word", "at", "n")
    words = cut(chunk_words.groupBy("word").agg(F.sum("n").alias("n")), "ctw-words")
    trained = texts.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    grams = cut(chunk_grams.groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    values = cut(gram_values(grams, depth), "ctw-values")
    # a word whose count is that of its chunk alone needs no answer
    counts = cut(chunk_words.join(words.withColumnRenamed("n", "value"), "word").where("n <> value").select(
        "part", "at", F.lit(None).cast("long").alias("gram"), F.col("value").cast("double").alias("value")), "ctw-asked")
    prices = cut(chunk_grams.select("part", "gram").join(values, "gram").select(
        "part", F.lit(None).cast("long").alias("at"), "gram", "value"), "ctw-asked")
    discard(words, grams, values)
    asked = prices.unionByName(counts)
    out = StructType([
        StructField("id", id_type), StructField("held", BooleanType()), *[StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        StructField("base_score", DoubleType()), StructField("score", DoubleType()), StructField("n_bytes", LongType()),
        StructField("bits_per_byte", DoubleType())])
    fit = scorer(depth, int(sums[0]) + int(trained), int(sums[1]) + (trained > 0), int(trained), to_arrow_schema(out))
    return texts.groupBy("chunk").cogroup(asked.groupBy("part")).applyInArrow(fit, out)


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held=held).withColumnsRenamed({"id": "doc_id", "held": "held_out"})
