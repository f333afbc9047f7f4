import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import neardups, quality, substrings, vectors, warc
from loadlens.llm.common import cut

from . import odd


# --- archives -------------------------------------------------------------------------------------------------

def pages(spark):
    same, long_ = "<p>" + "same " * 40, "z" * (17 << 20)
    rows = [(3, "http://a/x y\n", same), (1, "http://b", same), (2, None, same), (None, "http://c", same), (4, "u", None),
            (5, "u", ""), (6, "u", "tiny"), (7, "u", "tiny"), (8, "u", long_), (9, "ü", "é" * 60), (9, "ü", "é" * 60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, folder):
    rows, df = pages(spark)
    warc.write_archives(warc.with_revisits(df), folder + "/warc")
    got = warc.read_archives(spark, folder + "/warc").collect()
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
    want = Counter()
    for i, url, html in rows:
        body = (html or "").encode()
        again = html is not None and "same" in html and i != 1
        want[(i, url, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None)] += 1
    assert Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in got) == want
    assert all(bytes(r["payload"]) == (dict((i, h) for i, _, h in rows)[r["page_id"]] or "").encode()
               for r in got if r["record_type"] == "response")
    warc.write_archives(warc.with_revisits(df.limit(0)), folder + "/none")
    assert warc.read_archives(spark, folder + "/none").count() == 0


def member(i, compress=True):
    body = f"<p>{i} ".encode() * 50
    data = warc.warc_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None, "2000-01-01T00:00:00Z")
    return warc.gzip_member(data, 6) if compress else data


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_later_records_and_logs_gaps(compress):
    parts = [member(i, compress) for i in range(6)]
    start = [sum(map(len, parts[:i])) for i in range(7)]
    data = bytearray(b"".join(parts))
    data[start[3] - (40 if compress else 300)] ^= 0xFF
    found = list(warc.salvage(bytes(data)))
    assert [f["page_id"] for *_, f in found if isinstance(f, dict)] == [0, 1, 3, 4, 5]
    assert [(a, b) for a, b, f in found if isinstance(f, str)] == [(start[2], start[3])]
    junk = list(warc.salvage(b"\x1f\x8b\x08junk" + b"".join(parts[:2]) + parts[2][:-9]))
    assert [f["page_id"] for *_, f in junk if isinstance(f, dict)] == [0, 1]
    assert sum(isinstance(f, str) for *_, f in junk) == 2
    assert list(warc.salvage(b"")) == []


def ids_and_gaps(data):
    found = list(warc.salvage(data))
    return [f["page_id"] for *_, f in found if isinstance(f, dict)], [g for g in found if isinstance(g[2], str)]


def test_salvage_goes_on_inside_a_member_of_several_records():
    parts = [member(i, False) for i in range(6)]
    # One bad record, in a sound member.
    bad = bytearray(b"".join(parts))
    bad[sum(map(len, parts[:3])) - 100] ^= 0xFF
    whole = warc.gzip_member(bytes(bad), 6)
    after = member(9)
    got, gaps = ids_and_gaps(whole + after)
    low, high = len(parts[0] + parts[1]), len(parts[0] + parts[1] + parts[2])
    assert got == [0, 1, 3, 4, 5, 9]
    assert gaps == [(0, len(whole), f"wrong block digest at {low}-{high} of the member")]
    # A wrong checksum, and a member cut at its tail.
    wrong = bytearray(warc.gzip_member(b"".join(parts), 6))
    wrong[-6] ^= 0xFF
    got, gaps = ids_and_gaps(bytes(wrong) + after)
    assert got == [0, 1, 2, 3, 4, 5, 9] and [g[:2] for g in gaps] == [(0, len(wrong))]
    noise = [warc.warc_record(i, "u", b, hashlib.sha256(b).hexdigest(), None, "d") for i in range(5)
             for b in [np.random.default_rng(i).bytes(50_000)]]
    cut_off = warc.gzip_member(b"".join(noise), 6)[:-20_000]
    got, gaps = ids_and_gaps(cut_off)
    assert got == [0, 1, 2, 3] and gaps[-1][2].startswith("cut member") and all(g[:2] == (0, len(cut_off)) for g in gaps)
    # Damage in the middle: what comes before it stays.
    hit = bytearray(warc.gzip_member(b"".join(noise), 6))
    hit[130_000:130_200] = b"\xff" * 200
    got, gaps = ids_and_gaps(bytes(hit) + after)
    assert got[:2] == [0, 1] and got[-1] == 9 and gaps


# --- quality ---------------------------------------------------------------------------------------------------

def test_classifier_on_held_out_rows_and_odd_ones(spark):
    rows = [(i, odd.words(i, 60) if i % 3 else odd.words(i, 60).upper() + "!!", "en", "s", 0, 1, "k", 2, "r", 3, "n") for i in range(300)]
    docs = spark.createDataFrame(rows + odd.rows(), odd.SCHEMA)
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(300)] + [(0, 1, 0), (None, 1, 0), (5, None, 0), (6, 1, 0), (6, 1, 0)],
        "doc_id long, quality int, toxic int")
    model = quality.train_model(docs, labels)
    score = quality.scorer(model)
    held = docs.where((quality.fold(F.col("doc_id")) == 2) & (F.col("doc_id") > 20) & (F.col("doc_id") < 300))
    got = held.select("doc_id", score("text").alias("s")).collect()
    assert len(got) > 40 and np.mean([(r["s"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got]) > 0.95
    assert docs.select(score("text").alias("s")).where("s is null or s < 0 or s > 1").count() == 0
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.drop_rejected(odd.empty(spark), labels.limit(0)).count() == 0


def test_the_sample_is_bounded_in_rows_and_takes_any_id(spark):
    rows = [(0, f"copy {i}") for i in range(3000)] + [(i, f"text {i}") for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for ids in ("long", "string"):
        as_ids = [df.withColumn("doc_id", F.col("doc_id").cast(ids)) for df in (docs, labels)]
        for most in (5, 1000):
            got = quality.labelled_sample(*as_ids, "doc_id", "text", "quality", most).collect()
            assert len(got) == len({r["__id"] for r in got}) == min(most, sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40)))
        score = quality.scorer(quality.train_model(*as_ids))
        assert as_ids[0].where(score("text").isNull()).count() == 0


def test_ratios_against_counting_by_hand():
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 60, 9)) for _ in range(80)]
    y = np.where(draw.random(80) < 0.4, 1.0, -1.0)
    size = 1 << quality.BITS
    got = quality.log_ratios(rows, y)
    good, bad = ([r for r, label in zip(rows, y) if (label > 0) == side] for side in (True, False))
    for feature in range(70):
        shares = [(1 + sum(feature in r for r in part)) / (size + sum(map(len, part))) for part in (good, bad)]
        assert abs(got[feature] - np.log(shares[0] / shares[1])) < 1e-9


def test_one_class_or_no_labels():
    assert quality.fit([], np.empty(0))[3] == 0.0
    assert quality.fit([np.array([1])] * 4, np.array([1] * 4))[3] > 5
    assert len(quality.hashed_ngrams(None)) == len(quality.hashed_ngrams("")) == 0
    assert len(quality.hashed_ngrams("\ud800 a")) > 0


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 40, 8)) for _ in range(200)]
    y = np.where([(r < 12).sum() > (r > 28).sum() for r in rows], 1.0, -1.0)
    scale = draw.normal(size=1 << quality.BITS)
    weights, bias = quality.descend(rows, y, scale, 1.0, 200)
    inner = np.divide(weights, scale)

    def objective(w, b):
        return (w @ w + b * b) / 2 + sum(max(0, 1 - t * ((w * scale)[r].sum() + b)) for r, t in zip(rows, y))

    best = objective(inner, bias)
    for _ in range(20):
        step = np.zeros_like(inner)
        step[:40] = draw.normal(size=40) * 0.01
        assert objective(inner + step, bias) >= best - 1e-2


# --- substrings --------------------------------------------------------------------------------------------------

def brute_repeats(rows, window=13):
    first = {}
    for i, text in rows:
        place = substrings.LAST if i is None else i
        w = (text or "").encode().split()
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, place), place)
    out = Counter()
    for i, text in rows:
        place = substrings.LAST if i is None else i
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < place:
                gone[j:j + window] = True
        out[(i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    return out


def test_repeats_against_brute_force(spark):
    draw = random.Random(2)
    pool = [odd.words(100 + i, 17) for i in range(6)] + ["of the " * 9, "that " * 30]
    rows = [(draw.choice([None, i // 2, i]), " ".join(draw.choice(pool + [odd.words(1000 + i, 9)]) for _ in range(draw.randint(0, 6))))
            for i in range(80)]
    rows += [(r[0], r[1]) for r in odd.rows()]
    got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == brute_repeats(rows)
    assert substrings.drop_repeats(odd.docs(spark)).count() == len(odd.rows())
    assert substrings.drop_repeats(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("letters, rounds", [(2, 2), (3, 1), (9, 2), (40, 3)])
def test_equal_windows_have_equal_representatives(letters, rounds):
    draw = np.random.default_rng(letters)
    shared = draw.integers(0, letters, 30)
    texts = [np.r_[draw.integers(0, letters, draw.integers(0, 20)), shared, draw.integers(0, letters, draw.integers(0, 20))] for _ in range(40)]
    flat = substrings.mixed(np.concatenate(texts).astype(np.uint64) + np.uint64(5))
    with np.errstate(over="ignore"):
        starts, found = substrings.representatives(flat, np.cumsum([len(t) for t in texts]), 13, rounds)
    seen = {}
    for s, f in zip(starts, found):
        assert seen.setdefault(tuple(flat[s:s + 13]), f) == f
    assert len(starts) == sum(max(0, len(t) - 12) for t in texts)


def test_pieces_keep_whole_rows():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * n for n in (3, 0, 9, 2, 2, 0)], pa.list_(pa.int64()))], names=["x"])
    parts = list(substrings.pieces([batch], 0, 4))
    assert [p.num_rows for p in parts] == [2, 1, 3]
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()


# --- near-duplicates ---------------------------------------------------------------------------------------------

def labelled(text):
    w, seen, out = text.split(), Counter(), []
    for j in range(len(w) - 4 if len(w) >= 5 else min(1, len(w))):
        s = tuple(w[j:j + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edited(text, n, seed):
    draw, w = random.Random(seed), text.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = f"e{draw.randint(0, 99)}"
    return " ".join(w)


def test_near_classes_against_brute_force(spark):
    texts = []
    for g in range(8):
        base = odd.words(500 + g, 90)
        texts += [base] + [edited(base, n, n) for n in (0, 1, 2, 3, 6)] + [odd.words(700 + g, 30) + " " + base]
    texts += ["a b", "a b", "a c", "", "  ", "w " * 30, "w " * 60]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[9]), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardups.near_classes(df).collect()
    assert len(got) == len(rows)
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    distinct = [t for t in dict.fromkeys(t for _, t in rows) if t and t.split()]
    seqs = {t: labelled(t) for t in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            x, y = seqs[a], seqs[b]
            m = lcs(x, y) if len(set(x) & set(y)) > 0.6 * max(len(x), len(y)) else 0
            if m / (len(x) + len(y) - m) >= 0.8:
                group[find(a)] = find(b)
    smallest = {}
    for i, t in rows:
        if t and t.split():
            k = find(t)
            smallest[k] = min(smallest.get(k, 1 << 60), 1 << 60 if i is None else i)
    want = Counter((i, smallest[find(t)] if t and t.split() else i) for i, t in rows)
    assert Counter((r["doc_id"], r["class"]) for r in got) == want
    kept = neardups.drop_near_duplicates(df).collect()
    groups = {find(t) for _, t in rows if t and t.split()}
    # One of each group; texts without words stay, but for repeated rows.
    assert len([r for r in kept if r["text"] and r["text"].split()]) == len(groups)
    assert sorted((r["doc_id"], r["text"]) for r in kept if not (r["text"] or "").split() and r["text"] is not None) == [(59, ""), (60, "  ")]


def test_near_on_odd_rows(spark):
    df = odd.docs(spark)
    kept = neardups.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sum(r["text"] == "one two" for r in got) == 1 and sum(r["doc_id"] == 1 for r in got) == 1
    assert neardups.drop_near_duplicates(odd.empty(spark)).count() == 0


def test_alignment_is_exact_within_the_band():
    draw = np.random.default_rng(3)
    for _ in range(60):
        a = draw.permutation(80).astype(np.uint64)
        b = np.delete(a, draw.integers(0, 80, 4))
        for _ in range(3):
            i, j = sorted(draw.integers(0, len(b), 2))
            b[i], b[j] = b[j], b[i]
        m = lcs(a.tolist(), b.tolist())
        true = m / (len(a) + len(b) - m)
        got = neardups.aligned_similarity(a, b)
        assert got == pytest.approx(true) if true >= 0.8 else got <= true + 1e-12


def test_a_bucket_of_many_copies_is_one_class(spark):
    base = odd.words(77, 200)
    rows = [(i, edited(base, 1, i)) for i in range(150)]
    got = neardups.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("class").distinct().collect()
    assert len(got) == 1


# --- vectors -----------------------------------------------------------------------------------------------------

def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(500, 16))
    x[100:140] = x[7] + draw.normal(size=(40, 16)) * 0.1
    x[140:200:2] = x[141:201:2] + draw.normal(size=(30, 16)) * 0.15
    x[200:230] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15),
             (905, [float("inf")] * 16), (906, [1e300] * 16), (907, [1e-300] * 16), (908, [1.0, 2.0]), (909, [2.0, 4.0]),
             (9, x[9].tolist()), (None, x[9].tolist())]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    out, recall = vectors.near_vectors(df, shard_size=120)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect())
    unit = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v)
            else (u := np.array(v) / np.max(np.abs(v))) / np.linalg.norm(u) for _, v in rows]
    n = len(rows)
    near = [[i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9
             for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in range(n) if near[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    smallest = {}
    for i in range(n):
        if unit[i] is not None:
            smallest[label[i]] = min(smallest.get(label[i], 1 << 60), rows[i][0] if rows[i][0] is not None else 1 << 60)
    want = Counter()
    for i in range(n):
        c = smallest[label[i]] if unit[i] is not None else rows[i][0]
        want[(rows[i][0], sum(near[i]), c, rows[i][0] == c)] += 1
    assert recall >= 0.97
    assert sum((got & want).values()) >= 0.99 * n
    assert vectors.near_vectors(df.limit(0))[0].count() == 0


def vector_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_a_group_of_near_vectors_larger_than_a_shard_is_whole(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=16) + draw.normal(size=(700, 16)) * 0.2
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    out, recall = vectors.near_vectors(vector_table(spark, x), shard_size=60)
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    assert np.mean([got[i] for i in range(700)]) >= 0.9 * want.mean() and recall >= 0.97
    # Of one graph of small shards alone, the audit falls short.
    _, nodes = vectors.nodes_of(vector_table(spark, x), "vec_id", "embedding")
    links = vectors.graph_links(vectors.shards_of(nodes, 60, 0), 0.9).select("a", "b").distinct()
    assert vectors.Audit(nodes, 0.9).recall(links, 100) < 0.9
    exact = vectors.near_vectors(vector_table(spark, x), shard_size=60, goal=1.1)[0].collect()
    assert [r["n_links"] for r in sorted(exact, key=lambda r: r["vec_id"])] == want.tolist()


def test_rare_pairs_come_from_the_graph_and_are_called_unproven(spark):
    """Until the audit had a bound, all nodes were asked here and the graph was thrown away."""
    draw = np.random.default_rng(7)
    x = draw.normal(size=(3000, 32))
    x[:3] = x[3:6] + draw.normal(size=(3, 32)) * 0.05
    _, nodes = vectors.nodes_of(vector_table(spark, x), "vec_id", "embedding")
    recall = vectors.Audit(nodes.limit(0), 0.9).recall(spark.createDataFrame([], "a long, b long"), 4)
    assert recall == 1 and recall.pairs == recall.asked == 0
    out, recall = vectors.near_vectors(vector_table(spark, x))
    assert 0 < recall.asked < 1500 and not recall.proven
    assert {r["vec_id"]: r["n_links"] for r in out.where("n_links > 0").collect()} == {i: 1 for i in range(6)}


def test_the_graph_alone_reaches_the_recall(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(600, 32))[draw.integers(0, 600, 4000)] + draw.normal(size=(4000, 32)) * 0.2
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    out, recall = vectors.near_vectors(vector_table(spark, x), shard_size=500)
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    assert recall.asked < 1500 and recall.proven and recall >= 0.97
    assert all(got[i] <= want[i] for i in range(4000)) and sum(got.values()) >= 0.97 * want.sum()


def test_written_tables_keep_schema(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    assert cut(df, "t").schema == df.schema and cut(df.limit(0), "t").count() == 0
