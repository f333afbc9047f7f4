import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loadlens.llm import decontamination, lines, mixing, privacy, secret_scan
from loadlens.llm.common import components
from loadlens.llm.spans import joined

from . import odd

PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]
SECRET = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m[2]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_spans(text, kinds):
    if len(text or "") > 20_000 and len(set(text)) < 3:  # backtracking would take hours here, and finds nothing
        return ""
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds)
             for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, i, e, k in sorted(found))


def random_texts(alphabet, n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 90))) for _ in range(n)]


def test_personal_spans_match_the_patterns(spark):
    texts = random_texts(["a", "b", ".", "@", "_", "%", "+", "-", " ", "1", "25", "(", ")", "\n", "é", "x@y.z", "1.2.3.4",
                          "4111 1111 1111 1111", "+1 555 555 0100"], 400, 3)
    texts += [r[1] for r in odd.rows()] + ["1" * 50_000, "1.2.3." * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = privacy.find_personal(df).select("doc_id", joined(F.col("base"), privacy.KINDS).alias("b"),
                                           joined(F.col("spans"), privacy.KINDS).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["b"] == brute_spans(texts[r["doc_id"]], PRIVATE)
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))
    assert privacy.find_personal(odd.empty(spark)).count() == 0
    long_ = spark.createDataFrame([(1, "a" * 50_000 + "@b." + "c." * 5_000 + "c " + "ab" * 90_000)], "doc_id long, text string")
    assert privacy.find_personal(long_).select(joined(F.col("base"), privacy.KINDS)).first()[0] == "email:0:60004"


def test_labelers_teach_the_classifier_about_rejected_numbers():
    good = [((1, 1, 1, 1), (16, 0), 2, 500), ((-1, 1, 1, 1), (16, 0), 2, 20)]
    bad = [((-1, -1, -1, -1), (13, 0), 2, 400), ((-1, -1, 0, -1), (14, 0), 2, 300)]
    scores = privacy.fit(good + bad)
    assert scores[(2, -1, 1, 1, 1, 16, 0)] > 0.9 > 0.1 > scores[(2, -1, -1, -1, -1, 13, 0)]
    assert privacy.fit([]) == {}


def test_secret_spans_match_the_patterns(spark):
    texts = random_texts(["token", "Secret", "api_key", "=", ":", '"', "'", " ", "a", "0f", "9c3", "AKIA", "Z9", "/", "ſ", "x",
                          "0123456789abcdef", "password"], 400, 5)
    texts += [r[1] for r in odd.rows()] + ["token=" * 900, "g" * 40_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got, _ = secret_scan.scan_secrets(df)
    for r in got.select("doc_id", joined(F.col("base"), secret_scan.KINDS).alias("b")).collect():
        assert r["b"] == brute_spans(texts[r["doc_id"]], SECRET)
    assert secret_scan.scan_secrets(odd.empty(spark))[0].count() == 0


def test_ownership_separates_examples_from_live_values(spark):
    live, shared = "ghp_q8Zr5Tn2Xw7Lk4Vb9Mc1", "ghp_a1B2c3D4e5F6g7H8i9J0"
    rows = [(i, f"see {shared} ok", f"o{i % 4}") for i in range(40)] + [(99, f"key {live}", "o1"), (99, f"key {live}", "o1"),
                                                                     (100, f"and {shared}", None)]
    out, values = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r["owners"], r["repos"], r["class"]) for r in values.collect()} == {(5, 41, "example"), (1, 1, "live")}
    spans = {r["doc_id"]: r["s"] for r in out.select("doc_id", joined(F.col("spans"), secret_scan.KINDS).alias("s")).collect()}
    assert spans[99] == f"prefixed:4:{4 + len(live)}" and spans[3] == "" and out.count() == len(rows)


def brute_lines(rows, min_sites, min_words):
    spread, first = defaultdict(set), {}
    for i, text, site in rows:
        for pos, raw in enumerate((text or "").split("\n") if text is not None else []):
            line = raw.strip(" \t\n\v\f\r")
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= min_words:
                spread[line].add(site)
                key = (i is not None, i or 0, pos)
                first[line] = min(first.get(line, key), key)
    out = []
    for i, text, site in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        parts = text.split("\n")
        kept = [raw for pos, raw in enumerate(parts) if not (
            len(spread.get(raw.strip(" \t\n\v\f\r"), ())) >= min_sites
            and first[raw.strip(" \t\n\v\f\r")] != (i is not None, i or 0, pos))]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    draw = random.Random(1)
    pool = [odd.words(s, 6) for s in range(12)] + ["short line", "", "  " + odd.words(3, 6) + "\t"]
    rows = [(i if i % 9 else None, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 6))) if i % 11 else None,
             f"s{draw.randint(0, 7)}" if i % 5 else None) for i in range(60)]
    rows += [(r[0], r[1], r[3]) for r in odd.rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sites in (2, 6):
        got = lines.drop_boilerplate(df, min_sites=sites, report=True).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert Counter(map(tuple, got)) == Counter(brute_lines(rows, sites, 1))
        got = lines.drop_boilerplate(df, min_sites=sites, min_words=5, report=True).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert Counter(map(tuple, got)) == Counter(brute_lines(rows, sites, 5))
    assert lines.drop_boilerplate(odd.docs(spark)).columns == odd.docs(spark).columns
    assert lines.drop_boilerplate(odd.empty(spark)).count() == 0


def test_short_lines_follow_the_same_rule(spark):
    rows = [(i, f"All rights reserved.\n\n{'On six sites.' if i < 6 else 'x' + str(i)}\nown {i} words", f"s{i}") for i in range(18)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df).collect()}
    assert got == {i: text if not i else text.removeprefix("All rights reserved.\n") for i, text, _ in rows}
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df, min_words=4).collect()}
    assert got == {i: text for i, text, _ in rows}


def test_a_text_of_very_many_lines(spark):
    """Removal takes time in proportion to the lines; with a search per line this text would take hours."""
    n = 400_000
    common = spark.range(1, 9).select(F.col("id").alias("doc_id"), F.lit("\n".join(f"common {i}" for i in range(50))).alias("text"))
    long = spark.range(9, 10).select(F.col("id").alias("doc_id"), F.expr(
        f"array_join(transform(sequence(1, {n}), i -> IF(i % 2 = 0, 'own ' || i, 'common ' || i % 50)), '\n')").alias("text"))
    df = common.unionByName(long).withColumn("source", F.concat(F.lit("s"), F.col("doc_id")))
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(df, report=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("d")).collect()}
    left = "\n".join(f"own {i}" for i in range(2, n + 1, 2))
    assert (got[9]["n_lines"], got[9]["n_removed"], got[9]["d"]) == (n, n // 2, hashlib.sha256(left.encode()).hexdigest())
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 50


def test_only_lines_near_the_threshold_are_counted_by_site(spark):
    made = lines.line_table(odd.docs(spark), "doc_id", "text", "source", 1)
    plan = lines.boilerplate(made, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("__site"):] and plan.index("Aggregate [__h1") < plan.rindex("LeftSemi")


def test_mix_meets_targets_and_reruns_agree(spark):
    df = odd.docs(spark)
    out, pieces = mixing.mix(df, block_tokens=16)
    got = out.collect()
    assert len(got) == df.count()
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == round(target[s]) and target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    again = mixing.mix(df.repartition(5), block_tokens=16)[0].collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert pieces.agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0] == sum(taken.values())
    assert mixing.mix(odd.empty(spark))[0].count() == 0


def brute_targets(sizes, weights=mixing.WEIGHTS):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * weight[s] / rest > 2 * sizes[s]] if rest else []
        if not over:
            return full | {s: left * weight[s] / rest for s in names if s not in full}
        for s in over:
            full[s] = 2 * sizes[s]
        left -= sum(full[s] for s in over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 50}, {"x": 5}, {"a": 0, "b": 7, "z": 900, "y": 1, "k": 60}])
def test_targets_are_those_of_repeated_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "__source string, __size long")
    got = {r["__source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_schedule_has_low_discrepancy(spark):
    targets = spark.createDataFrame([(0, 3000.0), (1, 1000.0), (2, 96.0)], "__place long, target double")
    slots = sorted((r["slot"], r["__place"], r["rank"]) for r in mixing.schedule(spark, targets, 1, bin_bits=4, chunk_bits=5).collect())
    seen = Counter()
    for n, (_, place, rank) in enumerate(slots, 1):
        assert rank == seen[place]
        seen[place] += 1
        assert abs(seen[0] - n * 3000 / 4096) < 14 and abs(seen[2] - n * 96 / 4096) < 14
    assert seen == {0: 3000, 1: 1000, 2: 96}


def test_leaks_and_new_parameters(spark):
    item = "A train leaves Paris at 60 km per hour and another train leaves Rome at 80 km per hour toward the first one"
    changed = item.replace("60", "45").replace("80", "95")
    broken = item.replace("60", "70").replace("80", "70")
    other = odd.words(9, 60)
    texts = [other + " " + item + " " + other, changed.upper().lower(), broken, other, None, "", item[:40], "x " * 20_000 + item]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(
        [(1, item), (2, "too short"), (3, "what is the name of it all"), (None, None), (1, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 1): False, (7, 1): True}
    left = decontamination.decontaminate(docs, bench)
    assert sorted(r[0] for r in left.collect()) == [2, 3, 4, 5, 6]
    assert decontamination.decontaminate(odd.docs(spark), bench).columns == odd.docs(spark).columns
    assert decontamination.decontaminate(odd.empty(spark), bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 9


def test_names_are_names_wherever_they_stand(spark):
    bench = spark.createDataFrame([
        (1, "What is the capital of France?"),
        (2, "Anna has 3 apples. Bob gives her 4 more and takes 2 of them back. How many apples are left with Anna?")],
        "item_id long, text string")
    texts = ["Question: What is the capital of France? Answer: Paris", "so,  WHAT is the\n\ncapital of france and why",
             "Here: Clara has 7 apples. Tom gives her 5 more and takes 6 of them back. How many apples are left with Clara?",
             "Clara has 7 apples. Tom gives her 5 more and takes 6 of them back. How many apples are left with Tom?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 1): True, (2, 2): False}


def test_a_verbatim_run_is_a_leak_whatever_changed_behind_it(spark):
    item = "we put 2 red and some green balls in a box and then draw from it without looking until we have 2 of them"
    docs = spark.createDataFrame([(0, item.replace("2 of", "3 of")), (1, item.replace("2 red", "3 red"))], "doc_id long, text string")
    got = decontamination.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_matched"], r["same_values"]) for r in got} == {0: (21, True), 1: (21, True)}


def test_leak_windows_against_brute_force(spark):
    draw = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "12", "of", "the"]
    items = [[draw.choice(vocabulary) + str(draw.randint(0, 9) or "") for _ in range(n)] for n in (5, 6, 7, 8, 9, 10, 14, 30)]
    docs = []
    for i in range(160):
        words = [draw.choice(vocabulary) + "q" for _ in range(draw.randint(0, 40))]
        it = draw.choice(items)
        a = draw.choice([0, draw.randint(0, len(it) - 1)])
        words[len(words) // 2:len(words) // 2] = it[a:a + draw.randint(1, 30)]
        docs.append((i, " ".join(words)))
    found = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in found.collect()}
    want, typed = set(), set()
    shape = lambda t: re.sub("[0-9]+", "#", t)
    for i, text in docs:
        for j, it in enumerate(items):
            need = min(13, len(it))
            parts = [" ".join(it[k:k + need]) for k in range(len(it) - need + 1)]
            if any(f" {p} " in f" {text} " for p in parts):
                want.add((i, j))
            if any(f" {shape(p)} " in f" {shape(text)} " for p in parts):
                typed.add((i, j))
    assert len(want) > 60
    # every verbatim run is found, as such; whatever else is found agrees but for the numbers
    assert want == {k for k, same in got.items() if same} and set(got) <= typed


def test_planted_items_with_new_parameters(spark):
    draw = random.Random(8)
    verbs, things = ["buys", "sells", "packs", "counts", "paints"], ["apples", "boxes", "lamps", "stones", "tickets"]
    names = ["Anna", "Bob", "Clara", "Dario", "Elena", "Farid"]

    def question(k, who, other, a, b):
        return (f"{who} {verbs[k % 5]} {a} {things[k // 5 % 5]} of type {chr(97 + k)}x in the morning and gives {b} of them to {other} "
                f"before {who} walks home. How many {things[k // 5 % 5]} does {who} keep if {other} returns nothing at all?")

    items = [(k, question(k, "Gustav", "Hanna", 10 + k, 3 + k)) for k in range(25)]
    docs = []
    for k in range(25):
        who, other = draw.sample(names, 2)
        a, b = draw.sample(range(100, 999), 2)
        docs.append((k, odd.words(k, 30) + " " + question(k, who, other, a, b) + " " + odd.words(k + 99, 20)))
        # the same value twice where the item has two: another question
        docs.append((100 + k, odd.words(k, 30) + " " + question(k, who, who, a, a) + " " + odd.words(k + 99, 20)))
    found = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in found.collect()}
    assert {k for k in got if k[0] == k[1]} == {(k, k) for k in range(25)} and not any(got.values())
    assert not any(d >= 100 for d, _ in got)


def test_one_pass_over_the_documents(spark, folder):
    bench = spark.createDataFrame([(n, odd.words(n, n)) for n in (5, 6, 7, 8, 9, 10, 20, 30)], "item_id long, text string")
    spark.createDataFrame([(1, odd.words(20, 20))], "doc_id long, text string").write.parquet(folder + "/docs")
    scans = []
    real = decontamination.cut
    decontamination.cut = lambda df, name: (scans.append(df._jdf.queryExecution().executedPlan().toString().count(folder + "/docs")) if name == "leak-hits" else None, real(df, name))[1]
    try:
        assert decontamination.find_leaks(spark.read.parquet(folder + "/docs"), bench).count() == 1
    finally:
        decontamination.cut = real
    assert scans == [1]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
