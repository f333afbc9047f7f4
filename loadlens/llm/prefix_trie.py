"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation becomes rows of ``block`` turn ids side by side, each row keyed by the node that the block before it ends
in.  One ``ROLLUP(prior, t0 .. t7)`` then aggregates every prefix of every block at once; ``grouping_id`` tells its depth.
All blocks go through the same aggregation: a node is named by the 128-bit XOR of its (position, turn) hashes, so the prior
node of a block needs no result of the block before, and a conversation of any length takes no further round.

Two roll-ups are made.  The first gives members and the smallest member of each node.  A conversation *owns* the nodes of
which it is that smallest member; they are the last ones of its path.  Sums over subtrees so become sums over members: a
node's subtree has as many leaves as members own childless ends, and saves what its members hold below it and do not own.

Nulls: a null role or text is empty; a row without conversation id belongs to none and is ignored.  Turns that tie are
ordered by role and text; repeated rows are turns of their own.  A conversation without turns is a member of the root only.
No rows at all give an empty result.  Extra columns are ignored.  Conversation ids must be whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import cut, table
from loadlens.llm.turns import digests, numbered, two_hashes

#: Ids that are listed together before a node's list of members is digested.
ID_SPAN = 4096
NODE = ["depth", "__a", "__b"]


def turn_rows(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, a, b, chars) per turn: position from 0, 128 bits of role and text, code points of the text."""
    rows = convs.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("__turn"),
        F.coalesce(role, F.lit("")).alias("__role"), F.coalesce(text, F.lit("")).alias("__text"))
    a, b = two_hashes(F.col("__role"), F.col("__text"))
    return numbered(rows, "conv_id", "__turn", ["__role", "__text"], "pos").select(
        "conv_id", "pos", a.alias("a"), b.alias("b"), F.char_length("__text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Conversations that open with the first h turns of the first conversation of their hundred; h = crc32(id) % 6.

    At most ``most`` - 1 turns are lent, to at most ``span`` conversations each.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("a").alias("n"))
    heads = sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = heads.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("k"))
    lent = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    opening = heads.join(lent, "base").where(F.col("pos") < F.col("k")).select("conv_id", "pos", "a", "b", "chars")
    own = turns.join(heads, "conv_id").where(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "a", "b", "chars")
    return opening.unionByName(own)


def _columns(block: int) -> list[str]:
    return [f"t{j}" for j in range(block)]


def block_rows(paths: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: the node before the block, its turn ids as columns, null after the end."""
    at = F.pmod("depth", F.lit(block))
    turn = F.struct(F.col("xa").alias("a"), F.col("xb").alias("b"), "chars")
    rows = paths.groupBy("conv_id", F.floor(F.col("depth") / block).alias("block")).agg(
        F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"),
        *[F.max(F.when(at == j, turn)).alias(t) for j, t in enumerate(_columns(block))])
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(x).over(ahead), F.lit(0)).alias(x[1:]) for x in ("xa", "xb")]
    return rows.select("conv_id", F.struct("block", *before).alias("prior"), *_columns(block))


def roll_up(blocks: DataFrame, block: int, measures: list[Column], at_level: dict[str, list[Column]]) -> DataFrame:
    """One row per node: depth, its name, its parent's name, ``measures``, and of ``at_level`` the measure of its level."""
    names = _columns(block)
    level = F.lit(block) - F.log2(F.grouping_id() + 1).cast("int")
    rolled = blocks.rollup("prior", *names).agg(
        level.alias("__level"), *measures, *[c.alias(f"__{n}{j}") for n, cs in at_level.items() for j, c in enumerate(cs)])
    last = F.element_at(F.array(*names), F.col("__level"))
    nodes = rolled.where(F.col("__level") > 0).withColumn("__last", last).where(F.col("__last").isNotNull())

    def name(x: str) -> Column:
        found = F.col(f"prior.{x}")
        for t in names:
            found = found.bitwiseXOR(F.coalesce(F.col(f"{t}.{x}"), F.lit(0)))
        return found

    picked = [F.element_at(F.array(*[F.col(f"__{n}{j}") for j in range(len(cs))]), F.col("__level")).alias(n)
              for n, cs in at_level.items()]
    kept = [c for c in rolled.columns if c not in ("prior", "__level", *names) and not c.startswith("__")]
    return nodes.select(
        (F.col("prior.block") * block + F.col("__level") - 1).alias("depth"), name("a").alias("__a"), name("b").alias("__b"),
        name("a").bitwiseXOR(F.col("__last.a")).alias("__pa"), name("b").bitwiseXOR(F.col("__last.b")).alias("__pb"),
        *kept, *picked)


def prefix_trie(turns: DataFrame, block: int = 8) -> DataFrame:
    """All nodes of the trie over ``turns`` (conv_id, pos from 0, a, b, chars; a null ``a`` marks no turn).

    Gives conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    xa, xb = two_hashes(F.col("pos"), F.col("a"), F.col("b"))
    root = turns.select("conv_id").distinct().select(
        "conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(x) for x in ("xa", "xb", "chars")])
    paths = cut(turns.where(F.col("a").isNotNull()).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), xa.alias("xa"), xb.alias("xb"), "chars").unionByName(root), "trie-paths")
    blocks = cut(block_rows(paths, block), "trie-blocks")
    first = cut(roll_up(blocks, block, [F.min("conv_id").alias("conv_id")], {}), "trie-nodes")
    children = first.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("__pa").alias("__a"), F.col("__pb").alias("__b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    owned = first.join(children, NODE, "left").groupBy("conv_id").agg(
        F.min("depth").alias("from"), F.max_by(F.col("n_children").isNull(), "depth").alias("leaf"))
    # what a conversation holds and does not own, from each depth of its path to its end
    base = F.col("prior.block") * block
    lost = [F.when(F.coalesce(base + j < F.col("from"), F.lit(True)), F.coalesce(F.col(f"{t}.chars"), F.lit(0))).otherwise(0)
            for j, t in enumerate(_columns(block))]
    behind = Window.partitionBy("conv_id").orderBy(F.col("prior.block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.join(owned, "conv_id", "left").withColumn("lost", F.array(*lost))
    total = F.aggregate("lost", F.lit(0).cast("long"), lambda s, x: s + x)
    marked = marked.withColumn("__total", total).withColumn("__later", F.coalesce(F.sum("__total").over(behind), F.lit(0)))
    rest = [F.col("__later") + F.aggregate(F.slice("lost", j + 1, block), F.lit(0).cast("long"), lambda s, x: s + x) for j in range(block)]
    marked = marked.select("conv_id", "prior", *_columns(block), *[r.alias(f"r{j}") for j, r in enumerate(rest)],
                           F.when(F.col("leaf"), 1).otherwise(0).alias("leaf"))
    nodes = cut(roll_up(
        marked, block,
        [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves")],
        {"saved_tokens": [F.sum(f"r{j}") for j in range(block)]}), "trie-sums")
    ends = paths.groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.bit_xor("xa").alias("__a"), F.bit_xor("xb").alias("__b"))
    listed = ends.groupBy(*NODE, F.floor(F.col("conv_id") / ID_SPAN).alias("__span")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("__ids"))
    lists = digests(listed, NODE, ["__span"], "__ids", ",", "ends_sha256")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("__a").alias("__pa"), F.col("__b").alias("__pb"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(children, NODE, "left").join(lists, NODE, "left").join(parents, ["depth", "__pa", "__pb"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_rows(table(spark, sf_dir, "conversations"))
    held = cut(turns, "trie-turns")
    # a conversation all of whose turns are replaced by none stays, as a row without a turn
    ids = held.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("pos"), *[F.lit(None).cast("long").alias(x) for x in ("a", "b", "chars")])
    return prefix_trie(rebuilt(held).unionByName(ids))


SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, count(*) AS n, xor(list_reduce(
      [4294967295::BIGINT] || list_transform(range(0, 8 * length(conv_id::VARCHAR)),
        lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INTEGER, 1)) ELSE 0 END::BIGINT),
      lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 6 AS h
  FROM base GROUP BY conv_id),
heads AS (
  SELECT i.conv_id, i.h, i.conv_id - i.conv_id % 100 AS b, least(i.h, coalesce(s.n, 0)) AS k
  FROM ids i LEFT JOIN ids s ON s.conv_id = i.conv_id - i.conv_id % 100),
again AS (
  SELECT h.conv_id, t.pos + 1 AS depth, role, text FROM heads h JOIN base t ON t.conv_id = h.b AND t.pos < h.k
  UNION ALL
  SELECT h.conv_id, t.pos - h.h + h.k + 1, role, text FROM heads h JOIN base t ON t.conv_id = h.conv_id AND t.pos >= h.h
  UNION ALL SELECT conv_id, 0, '', '' FROM heads),
paths AS (
  SELECT conv_id, depth, length(text) AS chars,
    string_agg(CASE WHEN depth > 0 THEN md5(length(role) || ':' || role || text) ELSE '' END, '')
      OVER (PARTITION BY conv_id ORDER BY depth) AS node,
    max(depth) OVER (PARTITION BY conv_id) AS last
  FROM again),
nodes AS (
  SELECT node, depth, substr(node, 1, greatest(32 * (depth - 1), 0)) AS up, min(conv_id) AS conv_id, count(*) AS n,
    (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last = depth), '')) AS ends
  FROM paths GROUP BY node, depth),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
under AS (
  SELECT a.node, sum(b.saved) AS saved, count(*) FILTER (WHERE b.node NOT IN (SELECT up FROM kids)) AS leaves
  FROM nodes a JOIN nodes b ON starts_with(b.node, a.node) GROUP BY a.node)
SELECT x.conv_id::BIGINT AS conv_id, x.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, x.n::BIGINT AS n_convs,
  coalesce(k.n, 0)::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN under u ON u.node = x.node LEFT JOIN kids k ON k.up = x.node
LEFT JOIN nodes p ON x.depth > 0 AND p.node = x.up
"""
