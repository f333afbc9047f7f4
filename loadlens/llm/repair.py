"""Conversation repair: the cheapest edits that give ``(s?(ua)+)?``, by Hirschberg's divide and conquer.

Four states say what a repaired prefix ends in: nothing, system, user, assistant.  Keep, Rerole, Delete and Insert move
between them; from a state a letter leads to one state, so an audit names its path.  A cut through the conversation lies
right behind a row's own letter, so no audit of a prefix begins another one, and audits of prefixes are strictly ordered:
a forward vector holds, per state, the least cost and the rank of its least audit; a backward vector holds the cost to the
end.  They meet in the middle, the optimal crossing of the least rank is taken, and both halves are solved alike.  Only
vectors of four states are held, never a table of states by rows.

The same algebra works across tasks: ``BLOCK`` rows are summed up as one 4 x 4 matrix of (cost, rank), ``BLOCK`` such
matrices as one again, until a conversation is one matrix.  Its crossing is chosen there and handed down level by level.
No task holds more than ``BLOCK`` rows or matrices of a conversation; texts only stream by in order.

Nulls: a null role, text or turn is one space where rows are damaged; a null conversation id names a conversation of its
own.  Turns that tie are ordered by role and text; repeated rows are duplicates.  A conversation of no rows has empty
results.  No conversations give an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from loadlens.llm.common import cut, table
from loadlens.llm.turns import digests, numbered, two_hashes

BLOCK = 64
FAR = 1 << 40
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Row codes: the role's initial (x: another one) of a sound row, of a truncated one, and of one that must go.
SOUND, TRUNCATED, DOOMED = "suax", "SUAX", "1234"
#: Inserts that end a conversation, by state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
SUMMARY = StructType([StructField("cost", ArrayType(LongType())), StructField("rank", ArrayType(IntegerType()))])
EDITS = ArrayType(StructType([StructField(x, StringType()) for x in ("letters", "before", "role")]))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv:turn`` modulo 20: dropped, emptied, cut, repeated, or another's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = rows.select(conv, turn, blank(role).alias(role), blank(text).alias(text), kind.alias("__kind")).where("__kind <> 0")
    copies = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        conv, turn, F.when(F.col("__kind") == 4, F.lit("user")).otherwise(F.col(role)).alias(role),
        F.when(F.col("__kind") == 1, F.lit("")).when(F.col("__kind") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(F.col(text)).alias(text), copies.alias("__copy")).drop("__copy")


# ---- the four-state algebra ------------------------------------------------------------------------------------------

def step(state: int, letter: str, code: str) -> tuple[int, int] | None:
    """(state, cost) behind one letter, or None where it cannot stand."""
    place = DOOMED.find(code)
    if letter == "D":
        return state, 3
    onward = ASSISTANT if state == USER else USER
    if letter == "I":
        return onward, 2
    if place >= 0:
        return None
    late = code in TRUNCATED
    if letter == "R":
        return onward, 2 + late
    initial = code.lower()
    if initial == "s":
        return (SYSTEM, late) if state == NOTHING else None
    return (onward, late) if initial == "ua"[onward == ASSISTANT] else None


def row_ways(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each pair of states: the cheapest letters across one row, the least among equals."""
    ways: dict = {}
    for start in range(4):
        for inserts in range(3):
            state, cost = start, 0
            for _ in range(inserts):
                state, more = step(state, "I", code)
                cost += more
            for letter in "DKR":
                if after := step(state, letter, code):
                    found = (cost + after[1], "I" * inserts + letter)
                    key = (start, after[0])
                    ways[key] = min(ways.get(key, found), found)
    return ways


ROW_WAYS = {code: row_ways(code) for code in SOUND + TRUNCATED + DOOMED}


def matrix_of(ways: dict[tuple[int, int], tuple[int, str]]) -> tuple[list[int], list[int]]:
    """A row as a 4 x 4 matrix of costs, and of ranks within each start."""
    cost, rank = [FAR] * 16, [0] * 16
    for (start, end), (price, _) in ways.items():
        cost[4 * start + end] = price
    for start in range(4):
        letters = sorted((ways[start, end][1], end) for end in range(4) if (start, end) in ways)
        for place, (_, end) in enumerate(letters):
            rank[4 * start + end] = place
    return cost, rank


ROW_MATRIX = {code: matrix_of(ways) for code, ways in ROW_WAYS.items()}


def forward(matrices, start: int):
    """Least costs to each state behind ``matrices``, and the order of the least audits that reach them."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for prices, places in matrices:
        best = [(FAR, 0, 0)] * 4
        for s in range(4):
            if cost[s] < FAR:
                for t in range(4):
                    price = prices[4 * s + t]
                    if price < FAR:
                        best[t] = min(best[t], (cost[s] + price, rank[s], places[4 * s + t]))
        order = sorted(range(4), key=lambda t: best[t][1:])
        cost = [b[0] for b in best]
        rank = [order.index(t) for t in range(4)]
    return cost, rank


def backward(matrices, end: int):
    """Least costs from each state before ``matrices`` to ``end``."""
    cost = [FAR] * 4
    cost[end] = 0
    for prices, _ in reversed(matrices):
        cost = [min(FAR, *(prices[4 * s + t] + cost[t] for t in range(4))) for s in range(4)]
    return cost


def summed(matrices) -> tuple[list[int], list[int]]:
    """One matrix that stands for all of ``matrices`` in turn."""
    rows = [forward(matrices, s) for s in range(4)]
    return [c for cost, _ in rows for c in cost], [r for _, rank in rows for r in rank]


def crossings(matrices, start: int, end: int) -> list[int]:
    """The state behind each matrix on the least of the cheapest paths: halves meet, the crossing is chosen, recurse."""
    if len(matrices) == 1:
        return [end]
    half = len(matrices) // 2
    (there, rank), back = forward(matrices[:half], start), backward(matrices[half:], end)
    middle = min(range(4), key=lambda s: (there[s] + back[s], rank[s]))
    return crossings(matrices[:half], start, middle) + crossings(matrices[half:], middle, end)


def block_summary(codes: str):
    return summed([ROW_MATRIX[c] for c in codes])


def block_edits(codes: str, start: int, end: int) -> list[tuple[str, str, str | None]]:
    """Per row: its letters, the lines to insert before it, and its new role."""
    out, state = [], start
    for code, after in zip(codes, crossings([ROW_MATRIX[c] for c in codes], start, end)):
        letters = ROW_WAYS[code][state, after][1]
        lines = []
        for _ in letters[:-1]:
            lines.append("assistant:" if state == USER else "user:")
            state = ASSISTANT if state == USER else USER
        role = ("user", "assistant")[after == ASSISTANT] if letters[-1] == "R" else None
        out.append((letters, "\n".join(lines), role))
        state = after
    return out


# ---- on Spark --------------------------------------------------------------------------------------------------------

@F.pandas_udf(SUMMARY)
def _row_summary(codes: pd.Series) -> pd.DataFrame:
    known = {c: block_summary(c) for c in codes.unique()}
    found = [known[c] for c in codes]
    return pd.DataFrame({"cost": [f[0] for f in found], "rank": [f[1] for f in found]})


@F.pandas_udf(SUMMARY)
def _summary(costs: pd.Series, ranks: pd.Series) -> pd.DataFrame:
    found = [summed([(list(c), list(r)) for c, r in zip(cs, rs)]) for cs, rs in zip(costs, ranks)]
    return pd.DataFrame({"cost": [f[0] for f in found], "rank": [f[1] for f in found]})


@F.pandas_udf(ArrayType(IntegerType()))
def _crossings(costs: pd.Series, ranks: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([
        crossings([(list(c), list(r)) for c, r in zip(cs, rs)], int(s), int(t))
        for cs, rs, s, t in zip(costs, ranks, start, end)])


@F.pandas_udf(EDITS)
def _edits(codes: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    asked = list(zip(codes, start, end))
    known = {x: [{"letters": a, "before": b, "role": c} for a, b, c in block_edits(x[0], int(x[1]), int(x[2]))] for x in set(asked)}
    return pd.Series([known[x] for x in asked])


def _blocks(df: DataFrame, keys: list[str], at: str, *fields: str) -> DataFrame:
    """Bounded lists: ``BLOCK`` consecutive rows of a conversation, in order."""
    return df.groupBy(*keys, F.floor(F.col(at) / BLOCK).alias("__up")).agg(
        F.sort_array(F.collect_list(F.struct(at, *fields))).alias("__list"))


def _is(value: str):
    return lambda x: x == value


def solve(blocks: DataFrame) -> DataFrame:
    """``blocks`` (conv, block, codes) with the states that the least of the cheapest paths enters and leaves them in.

    Levels of matrices are written one by one; their number is the logarithm of the longest conversation.
    """
    parts = _row_summary("codes")
    levels = [cut(blocks.select("conv", F.col("block").alias("at"), parts.alias("m")).select("conv", "at", "m.*"), "repair-level")]
    while levels[-1].agg(F.max("at")).first()[0]:
        lists = _blocks(levels[-1], ["conv"], "at", "cost", "rank")
        parts = _summary(F.col("__list.cost"), F.col("__list.rank"))
        levels.append(cut(lists.select("conv", F.col("__up").alias("at"), parts.alias("m")).select("conv", "at", "m.*"), "repair-level"))
    ends = F.array_min(F.array(*[
        F.struct((F.col("cost")[t] + 2 * len(CLOSING[t])).alias("cost"), F.col("rank")[t].alias("rank"), F.lit(t).alias("end"))
        for t in range(4)])).alias("best")
    states = levels.pop().select("conv", "at", ends).select(
        "conv", "at", F.lit(NOTHING).alias("start"), F.col("best.end").alias("end"))
    while levels:
        lists = _blocks(levels.pop(), ["conv"], "at", "cost", "rank").withColumnRenamed("__up", "at").join(states, ["conv", "at"])
        found = lists.withColumn("cross", _crossings(F.col("__list.cost"), F.col("__list.rank"), "start", "end"))
        each = F.transform("cross", lambda c, i: F.struct(
            F.element_at("__list.at", i + 1).alias("at"),
            F.when(i == 0, F.col("start")).otherwise(F.try_element_at("cross", i)).alias("start"), c.alias("end")))
        states = cut(found.select("conv", F.explode(each).alias("e")).select("conv", "e.*"), "repair-states")
    return blocks.join(states.withColumnRenamed("at", "block"), ["conv", "block"])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """(per conversation, edited rows) of conversations as they are.

    Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost and audit.  Edited rows: conv, pos, piece (the
    ``role:text`` lines that stand there, inserted ones included; null where the row goes) in the order of pos.
    ``conv`` is the id as text, one space for null.
    """
    key = F.coalesce(F.col(conv).cast("string"), F.lit(" "))
    text_ = F.coalesce(F.col(text), F.lit(" "))
    rows = rows.select(key.alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), text_.alias("text"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    short = ~F.substring(F.rtrim("text", F.lit("\x20\t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)
    a, b = two_hashes(F.col("role"), F.col("text"))
    held = cut(numbered(rows, "conv", "turn", ["role", "text"], "pos").select(
        "conv", "pos", "turn", "role", "text", blank.alias("blank"), short.alias("short"), initial.alias("initial"),
        a.alias("a"), b.alias("b")), "repair-rows")
    firsts = held.where("not blank").groupBy("conv", "a", "b").agg(F.min("pos").alias("seen"), F.count("pos").alias("n")).where("n > 1")
    again = held.where("not blank").select("conv", "pos", "a", "b").join(firsts, ["conv", "a", "b"]).where("pos > seen").select(
        "conv", "pos", F.lit(True).alias("again"))
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("short"), "t").otherwise("k")
    code = F.when(fault.isin("b", "d"), F.substring(F.lit(DOOMED), F.col("initial"), F.lit(1))).when(
        fault == "t", F.substring(F.lit(TRUNCATED), F.col("initial"), F.lit(1))).otherwise(
        F.substring(F.lit(SOUND), F.col("initial"), F.lit(1)))
    coded = held.select("conv", "pos", "turn", "blank", "short", "initial").join(again, ["conv", "pos"], "left").select(
        "conv", "pos", "turn", code.alias("code"), fault.alias("fault"))
    lists = _blocks(coded, ["conv"], "pos", "code", "fault", "turn")
    plain = F.translate(F.array_join("__list.code", ""), TRUNCATED + DOOMED, SOUND + SOUND)
    legal = sum((F.length(p) - F.length(F.replace(p, F.lit(pair), F.lit("")))) / 2 for p, pair in (
        (plain, "su"), (plain, "ua"), (plain, "au")))
    blocks = cut(lists.select(
        "conv", F.col("__up").alias("block"), F.array_join("__list.code", "").alias("codes"), plain.alias("plain"),
        legal.cast("long").alias("legal"),
        *[F.size(F.filter("__list.fault", _is(k))).cast("long").alias(n) for k, n in
          (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        F.size("__list").cast("long").alias("n")), "repair-blocks")
    edited = cut(solve(blocks).withColumn("edits", _edits("codes", "start", "end")), "repair-edits")
    # letters, faults and pairs across block borders
    last = F.lag(F.substring("plain", -1, 1)).over(Window.partitionBy("conv").orderBy("block"))
    edge = edited.withColumn("edge", F.coalesce(F.concat(last, F.substring("plain", 1, 1)).isin("su", "ua", "au"), F.lit(False)).cast("long"))
    letters = F.array_join("edits.letters", "")
    spent = lambda letter: F.length(letters) - F.length(F.replace(letters, F.lit(letter), F.lit("")))
    late = F.size(F.filter(F.arrays_zip(F.split("codes", ""), "edits.letters"), lambda z: z["0"].isin(*TRUNCATED) & ~z["letters"].endswith("D")))
    price = (2 * spent("I") + 2 * spent("R") + 3 * spent("D") + late).cast("long")
    whole = edge.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "n")],
        (F.sum("n") - 1 - F.sum("legal") - F.sum("edge")).alias("illegal"), F.sum(price).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", letters.alias("l")))), lambda x: x["l"]), "").alias("audit"),
        F.max_by("end", "block").alias("end"))
    turns = held.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    closing = F.element_at(F.array(*[F.lit(CLOSING[s]) for s in range(4)]), F.col("end") + 1)
    found = whole.join(turns, "conv", "left").select(
        "conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        (F.col("cost") + 2 * F.length(closing)).alias("cost"), F.concat("audit", closing).alias("audit"), "n",
        F.element_at(F.array(*[F.lit(x) for x in ("", "user:\nassistant:", "assistant:", "")]), F.col("end") + 1).alias("tail"))
    edits = edited.select("conv", "block", F.posexplode("edits").alias("i", "e")).select(
        "conv", (F.col("block") * BLOCK + F.col("i")).alias("pos"), "e.*")
    kept = F.when(~F.col("letters").endswith("D"), F.concat(F.coalesce("e_role", "role"), F.lit(":"), "text"))
    lines = held.select("conv", "pos", "role", "text").join(edits.withColumnRenamed("role", "e_role"), ["conv", "pos"]).select(
        "conv", "pos", F.concat_ws("\n", F.when(F.col("before") != "", F.col("before")), kept).alias("piece"),
        ((F.col("before") != "") | kept.isNotNull()).alias("any")).where("any").drop("any")
    tails = found.where("tail <> ''").select("conv", F.col("n").alias("pos"), F.col("tail").alias("piece"))
    return found.drop("n", "tail"), lines.unionByName(tails)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    whole, lines = repair(damaged(rows))
    hashes = digests(lines, ["conv"], ["pos"], "piece", "\n", "repaired_sha256")
    ids = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(whole, "conv", "left").join(hashes, "conv", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') AS k, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(
      [4294967295::BIGINT] || list_transform(range(0, 8 * length(id)),
        lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(id, (i // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT),
      lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 20 AS kind
  FROM src),
damaged AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY pos) AS copies
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged)),
rows_ AS (
  SELECT k, pos, turn, role || ':' || text AS line, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY pos) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN copies > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault, text
  FROM ranked),
path AS (
  SELECT k, 0::BIGINT AS pos, {'c': 0::BIGINT, 'l': '', 'o': ''} AS e, {'c': 1000000000::BIGINT, 'l': '', 'o': ''} AS s,
    {'c': 1000000000::BIGINT, 'l': '', 'o': ''} AS u, {'c': 1000000000::BIGINT, 'l': '', 'o': ''} AS a
  FROM (SELECT DISTINCT k FROM rows_)
  UNION ALL
  SELECT k, pos, {'c': e.c + 3, 'l': e.l || 'D', 'o': e.o},
    list_sort([{'c': s.c + 3, 'l': s.l || 'D', 'o': s.o}, {'c': e.c + CASE WHEN initial = 's' THEN late ELSE far END, 'l': e.l || 'K', 'o': e.o || line}])[1],
    list_sort([{'c': u1.c + 3, 'l': u1.l || 'D', 'o': u1.o},
      {'c': e.c + 2 + late, 'l': e.l || 'R', 'o': e.o || chr(10) || 'user:' || text}, {'c': s.c + 2 + late, 'l': s.l || 'R', 'o': s.o || chr(10) || 'user:' || text},
      {'c': a1.c + 2 + late, 'l': a1.l || 'R', 'o': a1.o || chr(10) || 'user:' || text},
      {'c': e.c + CASE WHEN initial = 'u' THEN late ELSE far END, 'l': e.l || 'K', 'o': e.o || line}, {'c': s.c + CASE WHEN initial = 'u' THEN late ELSE far END, 'l': s.l || 'K', 'o': s.o || line},
      {'c': a1.c + CASE WHEN initial = 'u' THEN late ELSE far END, 'l': a1.l || 'K', 'o': a1.o || line}])[1],
    list_sort([{'c': a1.c + 3, 'l': a1.l || 'D', 'o': a1.o}, {'c': u1.c + 2 + late, 'l': u1.l || 'R', 'o': u1.o || chr(10) || 'assistant:' || text},
      {'c': u1.c + CASE WHEN initial = 'a' THEN late ELSE far END, 'l': u1.l || 'K', 'o': u1.o || line}])[1]
  FROM (
    SELECT r.k, r.pos, r.initial, chr(10) || r.line AS line, r.text, 1000000000::BIGINT AS far, e, s,
      CASE r.fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 1 ELSE 1000000000 END::BIGINT AS late,
      list_sort([u, {'c': e.c + 2, 'l': e.l || 'I', 'o': e.o || chr(10) || 'user:'}, {'c': s.c + 2, 'l': s.l || 'I', 'o': s.o || chr(10) || 'user:'},
        {'c': a.c + 2, 'l': a.l || 'I', 'o': a.o || chr(10) || 'user:'}])[1] AS u1,
      list_sort([a, {'c': u.c + 2, 'l': u.l || 'I', 'o': u.o || chr(10) || 'assistant:'},
        {'c': e.c + 4, 'l': e.l || 'II', 'o': e.o || chr(10) || 'user:' || chr(10) || 'assistant:'},
        {'c': s.c + 4, 'l': s.l || 'II', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] AS a1
    FROM path p JOIN rows_ r ON r.k = p.k AND r.pos = p.pos + 1)),
done AS (
  SELECT k, list_sort([e, a, {'c': u.c + 2, 'l': u.l || 'I', 'o': u.o || chr(10) || 'assistant:'},
    {'c': s.c + 4, 'l': s.l || 'II', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] AS best
  FROM path p WHERE pos = (SELECT max(pos) FROM rows_ r WHERE r.k = p.k)),
counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY k)
SELECT i.conv_id::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM src) i LEFT JOIN done USING (k) LEFT JOIN counts USING (k)
"""
