"""Quality classifier: linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Indicators of a text are its distinct character trigrams, and its distinct one-, two- and three-grams of word shapes
(letters by case, digits, and punctuation as it is; a word that repeats the word before it has a shape of its own).  They
are hashed to 2^17 features.  Each indicator is scaled by the log ratio of its smoothed class counts; a linear model with
bias is fitted by dual coordinate descent on the hinge loss; a logistic curve fitted on a part of the sample that the
model has not seen turns margins into scores.

Null and empty texts have the bias as their margin and get a score like any other.  Labels that are null or contradict
each other are not learned from; a document labelled twice alike counts once, and of several rows of one id the one
with the smallest hash of its text is learned from.  Ids may be of any type.  Without labels of both classes every
score is the share of label 1, or 0.5 without labels.  Repeated rows get the same score.  An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.llm.common import cut, table

BITS = 17
#: The fit uses at most this many labelled rows, those with the smallest hashes of their id; scoring uses all rows.
MAX_LABELLED = 12_000
_SHAPE = np.zeros(0x110000, dtype=np.uint8)


def shapes() -> np.ndarray:
    """Class of each code point: lower 1, upper 2, other letters and marks 3, digit 4, space 0, the rest by itself."""
    if not _SHAPE[65]:
        ascii_ = np.arange(128)
        table_ = np.full(0x110000, 3, dtype=np.uint8)
        table_[:128] = ascii_ + 100
        for code in range(128, 0x2000):
            c = chr(code)
            table_[code] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isalpha() else 5
        table_[0x2000:0x2070] = 6
        for code in range(128):
            c = chr(code)
            if c.isalpha():
                table_[code] = 1 if c.islower() else 2
            elif c.isdigit():
                table_[code] = 4
        table_[[0x20, 9, 10, 11, 12, 13]] = 0
        _SHAPE[:] = table_
    return _SHAPE


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def hashed_ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    seen = np.zeros(1 << BITS, dtype=bool)
    if len(codes) > 2:
        thirds = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        seen[mixed(thirds) >> np.uint32(32 - BITS)] = True
    kind = shapes()[codes]
    runs = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(codes) else np.empty(0, np.int64)
    classes = kind[runs]
    inside = np.flatnonzero(classes)
    if len(inside):
        # A word's shape hashes the classes of its runs of characters, in order.
        first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
        nth = np.arange(len(inside)) - np.repeat(first, np.diff(np.r_[first, len(inside)]))
        shape = np.add.reduceat(mixed(classes[inside].astype(np.uint32) + (nth.astype(np.uint32) << np.uint32(8))), first, dtype=np.uint32)
        ident = np.add.reduceat(codes * codes, runs[inside[first]], dtype=np.uint32)
        shape[1:][ident[1:] == ident[:-1]] = 7
        grams = [mixed(shape + np.uint32(1))]
        if len(shape) > 1:
            grams.append(mixed(mixed(shape[:-1]) + shape[1:] * np.uint32(3)))
        if len(shape) > 2:
            grams.append(mixed(mixed(mixed(shape[:-2]) + shape[1:-1]) + shape[2:] * np.uint32(5)))
        seen[np.concatenate(grams) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows are feature numbers, values are ``scale``, the bias is a feature."""
    weights, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            if step := new - alpha[i]:
                alpha[i] = new
                weights[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                worst = max(worst, abs(step) * square[i])
        if worst < 1e-3:
            break
    return weights * scale, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps on softened targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 1e-3), float(b)


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per feature: log of its share in the rows of class 1 over its share in the others, each count raised by one."""
    counts = np.ones((2, 1 << BITS))
    for row, label in zip(rows, y):
        counts[int(label > 0), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float, float, float]:
    """Model (weights, bias, a, b) of indicator rows and 0/1 labels."""
    none = np.zeros(1 << BITS)
    if len(set(labels)) < 2:
        share = float(np.mean(labels)) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return none, 0.0, 1.0, float(np.log(share / (1 - share)))
    y = np.where(labels > 0, 1.0, -1.0)

    def train(part):
        chosen = [rows[i] for i in part]
        return descend(chosen, y[part], log_ratios(chosen, y[part]), c, rounds)

    aside = np.arange(len(rows)) % 4 == 0
    seen, unseen = np.flatnonzero(~aside), np.flatnonzero(aside)
    if min((y[seen] > 0).sum(), (y[seen] < 0).sum(), (y[unseen] > 0).sum(), (y[unseen] < 0).sum()) == 0:
        return (*train(np.arange(len(rows))), 2.0, 0.0)
    weights, bias = train(seen)
    a, b = logistic(np.array([weights[rows[i]].sum() + bias for i in unseen]), y[unseen])
    return (*train(np.arange(len(rows))), a, b)


def fold(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4


def labelled_sample(docs: DataFrame, labels: DataFrame, id_: str, text: str, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` training rows (text, label): rows outside the held-out fold, in order of a hash."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_).isNotNull() & (fold(F.col(id_)) != 2))
        .groupBy(F.col(id_).alias("__id")).agg(F.min(label).alias("__y"), F.max(label).alias("__z")).where("__y = __z")
        .select("__id", F.xxhash64("__id").alias("__order"), F.col("__y").cast("int").alias("__y"))
        .orderBy("__order", "__id").limit(max_rows)
    )
    known = cut(known, "quality-sample")
    rows = docs.select(F.col(id_).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    # One row of each id, chosen before anything meets in one task.
    return rows.groupBy("__id", "__order", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("__row")).select(
        "__order", F.col("__id").cast("string").alias("__id"), F.col("__row.t").alias("__text"), "__y")


def train_model(docs: DataFrame, labels: DataFrame, id_="doc_id", text="text", label="quality", max_rows=MAX_LABELLED):
    """Model fitted on the bounded sample.  Rows are turned to features in parallel; one task fits them."""
    sample = labelled_sample(docs, labels, id_, text, label, max_rows)

    def featurise(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["__order"], "id": batch["__id"], "y": batch["__y"],
                                "x": [hashed_ngrams(t).astype(np.int32) for t in batch["__text"]]})

    def fit_all(batches):
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["key", "id"])
        weights, bias, a, b = fit(rows["x"].tolist(), rows["y"].to_numpy(dtype=int))
        yield pd.DataFrame({"weights": [weights.astype(np.float32)], "bias": [bias], "a": [a], "b": [b]})

    made = (
        sample.mapInPandas(featurise, "key long, id string, y int, x array<int>").repartition(1)
        .mapInPandas(fit_all, "weights array<float>, bias double, a double, b double")
    )
    made = made.collect()
    return made[0] if made else fit_empty()


def fit_empty() -> T.Row:
    weights, bias, a, b = fit([], np.empty(0))
    return T.Row(weights=weights.tolist(), bias=bias, a=a, b=b)


def scorer(model):
    """A column function from text to score.  The model is 2^17 weights, whatever the corpus."""
    spark = SparkSession.active()
    sent = spark.sparkContext.broadcast((np.array(model["weights"], np.float32), model["bias"], model["a"], model["b"]))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        weights, bias, a, b = sent.value
        margins = np.array([float(weights[hashed_ngrams(t)].sum(dtype=np.float64)) + bias for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(a * margins + b, -700, 700))), dtype="float64")

    return score


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", **options) -> DataFrame:
    """``docs`` whose score reaches the threshold."""
    score = scorer(train_model(docs, labels, text=text, **options))
    return docs.where(score(F.col(f"`{text}`")) >= threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = scorer(train_model(docs, labels))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
