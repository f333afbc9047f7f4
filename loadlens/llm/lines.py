"""Cross-site boilerplate removal by the spread of a line over distinct sites.

Every line (trimmed, not blank, of at least ``min_words`` words) gets a HyperLogLog sketch of its sites; sketches merge by
aggregation.  Lines whose estimate is clearly at or above ``min_sites`` are boilerplate, lines clearly below are not.  Only
the lines near it are looked up again for an exact distinct count.  The occurrence with the smallest (id, position) stays;
all others are removed.

A null text stays null and has no lines.  A null site is one site of its own.  Rows equal in id and text share their
first occurrence.  Blank lines are never touched.  A text of any number of lines takes time in proportion.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import cut, row_key, table

#: Sketches of 2^12 registers have a relative error of 1.04 / 2^6; the band that is counted exactly is six of these wide.
SKETCH_BITS = 12
BAND = 6 * 1.04 / 2 ** (SKETCH_BITS / 2)
TRIM = "\x20\t\n\x0b\x0c\r"


def line_table(docs: DataFrame, id_: str, text: str, site: str, min_words: int) -> DataFrame:
    """One row per line that counts: document key, id, site, position, 128-bit line hash."""
    enough = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (min_words - 1)
    # Keys come before the lines are opened: once a text, not once a line.
    keyed = docs.where(F.col(text).isNotNull()).select(
        *row_key(id_, text), F.col(id_).alias("__id"), F.col(site).alias("__site"), F.split(text, "\n").alias("__lines"))
    lines = keyed.select("__k1", "__k2", "__id", "__site", F.posexplode("__lines").alias("__pos", "__line"))
    line = F.trim(F.col("__line"), F.lit(TRIM))
    return lines.where(F.col("__line").rlike(enough) if min_words > 1 else line != "").select(
        "__k1", "__k2", "__id", "__site", "__pos",
        F.xxhash64(line).alias("__h1"), F.xxhash64(F.lit("line"), line).alias("__h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of lines seen on at least ``min_sites`` distinct sites, with the first occurrence of each."""
    margin = BAND * min_sites + 1
    spread = cut(
        lines.groupBy("__h1", "__h2").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg(
                F.xxhash64(F.col("__site").isNull(), F.col("__site")), SKETCH_BITS)).alias("__est"),
            F.min(F.struct("__id", "__pos")).alias("__first"))
        .where(F.col("__est") >= min_sites - margin), "line-spread")
    near = spread.where(F.col("__est") <= min_sites + margin)
    # The lines near the threshold are taken out first, so only theirs are counted by site.
    sites = lines.join(near.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").groupBy("__h1", "__h2", "__site").agg(F.lit(1).alias("__one"))
    counted = sites.groupBy("__h1", "__h2").agg(F.sum("__one").alias("__sites")).where(F.col("__sites") >= min_sites)
    exact = near.join(counted, ["__h1", "__h2"], "left_semi")
    return spread.where(F.col("__est") > min_sites + margin).unionByName(exact).select("__h1", "__h2", "__first")


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines at the positions ``removed``: positions are hashed, and lines are split once."""
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed)
    # A lambda over an array of one holds the split lines, so that the inner one does not split again for each position.
    once = F.transform(F.array(F.struct(parts.alias("parts"), kept.alias("kept"))),
                       lambda s: F.array_join(F.transform(s["kept"], lambda i: F.get(s["parts"], i)), "\n"))
    return F.get(once, F.lit(0))


def drop_boilerplate(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8,
    min_words: int = 1, report: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``; all rows and columns stay.

    ``report`` adds n_lines and n_removed.
    """
    lines = cut(line_table(docs, id_, text, site, min_words), "lines")
    bad = cut(boilerplate(lines, min_sites), "line-bad")
    removed = (
        lines.join(bad, ["__h1", "__h2"]).where(~F.struct("__id", "__pos").eqNullSafe(F.col("__first")))
        .groupBy("__k1", "__k2").agg(F.collect_set("__pos").alias("__removed"))
    )
    removed = cut(removed, "line-removed")
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *row_key(id_, text))
    marked = packed.join(removed, ["__k1", "__k2"], "left")
    old = F.col(f"__row.`{text}`")
    new = F.when(F.col("__removed").isNull(), old).otherwise(without_lines(old, F.col("__removed")))
    out = [(new if c == text else F.col(f"__row.`{c}`")).alias(c) for c in columns]
    if report:
        out += [F.when(old.isNull(), 0).otherwise(F.size(F.split(old, "\n"))).cast("long").alias("n_lines"),
                F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed")]
    return marked.select(*out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines and the SHA-256 of what stays."""
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"), report=True)
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
split AS (SELECT rid, doc_id, source, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL),
lines AS (
  SELECT rid, doc_id, source, pos, parts[pos] AS raw, trim(parts[pos], E' \t\n\x0b\x0c\r') AS line
  FROM (SELECT rid, doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split)),
counted AS (
  SELECT * FROM lines WHERE line <> ''),
spread AS (
  SELECT line, count(DISTINCT coalesce('s' || source, 'n')) AS sites, min(struct_pack(a := doc_id, b := pos)) AS first
  FROM counted GROUP BY line),
removed AS (
  SELECT c.rid, c.pos FROM counted c JOIN spread s ON c.line = s.line
  WHERE s.sites >= 8 AND struct_pack(a := c.doc_id, b := c.pos) IS DISTINCT FROM s.first),
kept AS (
  SELECT l.rid, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE r.pos IS NULL) AS text,
    count(*) AS n_lines, count(r.pos) AS n_removed
  FROM lines l LEFT JOIN removed r ON l.rid = r.rid AND l.pos = r.pos GROUP BY l.rid)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.rid = k.rid
"""
