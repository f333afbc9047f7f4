import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loadlens.llm import ctw, prefix_trie, queries, repair
from loadlens.llm.turns import digests

TURNS = "conv_id long, turn long, role string, text string, block long, prior string, __a long, pos long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS)


def random_rows(seed, convs=40, longest=9):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        n = 31 if c == 5 else draw.randint(1, longest)
        for t in range(n):
            rows.append((c * 37 % 250, draw.choice([t, t, t, max(t - 1, 0), None]), draw.choice(["user", "assistant", "assistant", "system", None, "tool"]),
                         draw.choice(["a.", "bé?", "c", "", " \n", None, "d! ", "e\x85"])))
    return rows + rows[:3]


def in_order(rows, null):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append(((t is not None, t or 0), null if role is None else role, null if text is None else text, t))
    return {c: sorted(v, key=lambda r: r[:3]) for c, v in convs.items()}


# --- prefix trie ------------------------------------------------------------------------------------------------------

def brute_trie(paths):
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[:len(p)] == p]
        ends = sorted(c for c in members if len(paths[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p],
                    sum(not kids[q] for q in under), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q),
                    sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_trie_against_brute_force(spark, block):
    rows = random_rows(block)
    turns = {c: [r[1:3] for r in v] for c, v in in_order(rows, "").items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    held = prefix_trie.turn_rows(conversations(spark, rows + [(None, 1, "user", "of nobody")]))
    ids = held.selectExpr("conv_id", "-1L pos", "null a", "null b", "null chars").distinct()
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(held).unionByName(ids), block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(paths)


def test_trie_of_nothing_and_of_one_long_conversation(spark, folder):
    none = prefix_trie.turn_rows(conversations(spark, []))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(none)).count() == 0
    got = prefix_trie.prefix_trie(prefix_trie.turn_rows(conversations(spark, [(7, t, "user", "x" * 3) for t in range(500)])))
    rows = got.collect()
    assert len(rows) == 501 and max(r["depth"] for r in rows) == 500
    assert all(r["n_leaves"] == 1 and r["saved_tokens"] == 0 and r["n_convs"] == 1 for r in rows)


def test_lists_of_members_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_SPAN", 3)
    rows = [(i, 0, "user", "same text") for i in range(40)]
    got = prefix_trie.prefix_trie(prefix_trie.turn_rows(conversations(spark, rows))).where("depth = 1").collect()
    assert [r["ends_sha256"] for r in got] == [sha(",".join(map(str, range(40))))] and got[0]["saved_tokens"] == 39 * 9


def test_digests_stream_in_order(spark):
    df = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(300)], "k string, i int, piece string").repartition(7)
    got = {r["k"]: r["d"] for r in digests(df, ["k"], ["i"], "piece", "\n", "d").collect()}
    assert got == {k: sha("\n".join(f"{k}{i}" for i in range(300))) for k in "ab"}


# --- repair -----------------------------------------------------------------------------------------------------------

def brute_edits(rows):
    """Cheapest edits by trying all letters, row by row: (cost, audit, repaired rows)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    seen, faults = set(), []
    states = {("", 0, "", ())}

    def inserted(states):
        out = set(states)
        for _ in range(2):
            out |= {(n, c + 2, a + "I", o + ((("user", "assistant")[n == "a"], ""),)) for s, c, a, o in out for n in after[s] if n != "s"}
        return out

    for _, role, text, _ in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        late, made = fault == "truncated", set()
        for s, c, a, o in inserted(states):
            made.add((s, c + 3, a + "D", o))
            if fault in ("", "truncated"):
                for n in after[s]:
                    if role[:1] == n:
                        made.add((n, c + late, a + "K", o + ((role, text),)))
                    if n != "s":
                        made.add((n, c + 2 + late, a + "R", o + ((("user", "assistant")[n == "a"], text),)))
        best = {}
        for m in made:
            best[m[0]] = min(best.get(m[0], m), m, key=lambda x: x[1:])
        states = set(best.values())
    ends = [x for x in inserted(states) if x[0] in ("", "a")]
    s, cost, audit, out = min(ends, key=lambda x: x[1:3])
    return faults, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


@pytest.mark.parametrize("block", [2, 64])
def test_repair_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = random_rows(11 + block) + [(999, i, "assistant", "a!") for i in range(3)]
    whole, lines = repair.repair(conversations(spark, rows))
    hashes = {r["conv"]: r["h"] for r in digests(lines, ["conv"], ["pos"], "piece", "\n", "h").collect()}
    got = {r["conv"]: r for r in whole.collect()}
    want = in_order(rows, " ")
    assert set(got) == {str(c) for c in want}
    for c, turns in want.items():
        faults, cost, audit, text = brute_edits(turns)
        r, numbers = got[str(c)], [t[3] for t in turns if t[3] is not None]
        initials = [t[1][:1] for t in turns]
        assert (r["audit"], r["cost"]) == (audit, cost)
        assert hashes.get(str(c), sha("")) == sha(text)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def test_halves_meet_at_the_least_of_the_cheapest_audits():
    for codes in map("".join, itertools.product("suxA1", repeat=5)):
        cost, rank = repair.block_summary(codes)
        end = min(range(4), key=lambda t: (cost[t] + 2 * len(repair.CLOSING[t]), rank[t]))
        got = "".join(e[0] for e in repair.block_edits(codes, 0, end)) + repair.CLOSING[end]
        states = {0: (0, "")}
        for code in codes:
            made = {}
            for s, (c, a) in states.items():
                for (start, t), (price, letters) in repair.row_ways(code).items():
                    if start == s:
                        made[t] = min(made.get(t, (1 << 30, "")), (c + price, a + letters))
            states = made
        assert (cost[end] + 2 * len(repair.CLOSING[end]), got) == min((c + 2 * len(repair.CLOSING[s]), a + repair.CLOSING[s]) for s, (c, a) in states.items())


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    kinds = Counter((c, t, zlib.crc32(f"{c}:{t}".encode()) % 20) for c, t, *_ in rows[:-1])
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damaged(conversations(spark, rows)).collect() if r["conv_id"] is not None)
    want = Counter()
    for c, t, k in kinds:
        if k:
            want[c, t, "user" if k == 4 else "assistant", "" if k == 1 else "One Two" if k == 2 else "One. Two!"] += 2 if k == 3 else 1
    assert got == want
    assert repair.repair(conversations(spark, []))[0].count() == 0


# --- language model ---------------------------------------------------------------------------------------------------

def weighted(counts, node, context, depth):
    """ln of the weighted probability of a context, straight from the definition."""
    a, b = counts[context, node]
    own = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    if len(context) == depth:
        return own
    children = {c for c, n in counts if n == node and len(c) == len(context) + 1 and c[1:] == context}
    under = sum(weighted(counts, node, c, depth) for c in children)
    return math.log(.5 * math.exp(own) + .5 * math.exp(under))


def bits(text, depth):
    data = bytes(depth) + text + b"\0"
    for i in range(depth, len(data)):
        node = 1
        for j in range(7, -1, -1):
            bit = data[i] >> j & 1
            yield [(data[i - d:i], node) for d in range(depth + 1)], bit
            node = 2 * node + bit


def test_code_lengths_follow_the_definition(spark):
    texts = [(1, "Abc abd", False), (2, "ab", False), (3, "abx", True), (4, None, True), (5, "", False), (1, "Abc abd", False), (None, "é", False)]
    docs = spark.createDataFrame([(*t, 1, "g") for t in texts], "doc_id long, text string, h boolean, gram long, chunk string")
    got = ctw.score_texts(docs, held=docs["h"], depth=2).collect()
    counts = defaultdict(lambda: (0, 0))
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for _, t, held in texts:
        for nodes, bit in [] if held else bits(low(t).encode(), 2):
            for n in nodes:
                counts[n] = (counts[n][0] + 1 - bit, counts[n][1] + bit)
    words = Counter(w for _, t, held in texts if not held for w in low(t).split())
    n, v = sum(words.values()) + 5, len(words) + 1
    assert len(got) == len(texts)
    for i, t, held in texts:
        total = 0.0
        for nodes, bit in bits(low(t).encode(), 2):
            root = nodes[0]
            before = weighted(counts, root[1], b"", 2)
            more = defaultdict(lambda: (0, 0), counts)
            for x in nodes:
                more[x] = (more[x][0] + 1 - bit, more[x][1] + bit)
            total += weighted(more, root[1], b"", 2) - before
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in low(t).split()) + math.log10(6 / (n + v + 1))
        row = next(r for r in got if r["id"] == i and r["held"] == held)
        assert row["score"] == pytest.approx(total / math.log(10), rel=1e-9)
        assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["train_tokens"] == n
        assert (row["n_tokens"], row["n_known"]) == (len(low(t).split()) + 1, sum(words[w] > 0 for w in low(t).split()) + 1)


def test_long_texts_span_pieces_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 50)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 300)
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab \n") for _ in range(n)) for n in (0, 1, 3, 49, 50, 51, 700, 20)] * 3
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    small = {r["id"]: (r["score"], r["base_score"], r["n_known"]) for r in ctw.score_texts(docs).collect()}
    monkeypatch.undo()
    large = {r["id"]: (r["score"], r["base_score"], r["n_known"]) for r in ctw.score_texts(docs).collect()}
    assert set(small) == set(large) == {str(i) for i in range(24)}
    assert all(small[k] == pytest.approx(large[k], rel=1e-9) for k in small)
    assert ctw.score_texts(docs.limit(0)).count() == 0
    held = ctw.score_texts(docs, held=docs["doc_id"].isNotNull()).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in held)


def test_new_queries_are_registered():
    assert {"op11_prefix_trie", "op12_conversation_repair", "op13_context_tree"} <= set(queries.queries())
