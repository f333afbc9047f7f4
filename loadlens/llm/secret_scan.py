"""Secret scan with corpus-wide ownership frequency.

Base spans come from three patterns.  Further candidates are tokens with a provider's prefix.  Candidate values are
hashed, and each hash is counted over distinct owners and repositories of the whole corpus: a value that many owners
carry is a copied example, a value that a single owner carries and that looks random is live-looking.  Base spans always
stay; a further candidate becomes a span if it is live-looking.

A null or empty text has no spans.  A null owner or repository counts as one of its own.  Repeated rows count once.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import cut, row_key, table
from loadlens.llm.spans import SPAN, count_of, find, joined

#: The kinds in their order, and the base patterns.  Possessive quantifiers match the same and never
#: backtrack; a run of lower-case hex digits is matched whole or not at all.
KINDS = ("assign", "access", "hex", "prefixed", "jwt")
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: Prefixes that token issuers publish.
PREFIXED = r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}+"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your[_-]?|xxxx|(.)\1{7}|12345678|abcdefgh"


def candidates(text: Column) -> Column:
    always = lambda v: F.lit(True)
    long_enough = lambda v: F.length(v) >= 12
    return F.concat(
        find(text, ASSIGN, 0, always, long_enough, group=1), find(text, ACCESS, 1, always), find(text, HEX, 2, always),
        find(text, PREFIXED, 3, always), find(text, JWT, 4, always))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate value: distinct owners and repositories.  Every step is pre-aggregated before its shuffle."""
    repos = found.groupBy("__h1", "__h2", "__owner", "__repo").agg(F.first("__random").alias("__random"))
    owners = repos.groupBy("__h1", "__h2", "__owner").agg(
        F.count(F.lit(1)).alias("__repos"), F.first("__random").alias("__random"))
    return owners.groupBy("__h1", "__h2").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("__repos").alias("repos"), F.first("__random").alias("__random"))


def scan_secrets(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
    example_owners: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(documents with base spans, all spans and class counts; candidate values with their ownership and class)."""
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = cut(docs.select(
        *row_key(id_, text, owner, repo), F.col(id_).alias("__id"), F.col(owner).alias("__owner"),
        F.col(repo).alias("__repo"), candidates(body).alias("__found")), "secret-found")
    found = scanned.where(F.size("__found") > 0).select(
        "__k1", "__k2", "__owner", "__repo", F.explode("__found").alias("__s"))
    value = F.col("__s.value")
    letters = F.array_distinct(F.split(value, ""))
    random = (F.size(letters) >= 8) & ~value.rlike(PLACEHOLDER) & value.rlike("[0-9]")
    found = found.select(
        "*", F.xxhash64(value).alias("__h1"), F.xxhash64(F.lit("secret"), value).alias("__h2"), random.alias("__random"))
    values = ownership(found).withColumn(
        "class", F.when(F.col("owners") >= example_owners, "example")
        .when((F.col("owners") == 1) & F.col("__random"), "live").otherwise("unclear"))
    values = cut(values.drop("__random"), "secret-values")
    classed = found.select("__k1", "__k2", "__s", "__h1", "__h2").join(values, ["__h1", "__h2"])
    per_doc = classed.groupBy("__k1", "__k2").agg(
        F.collect_set(F.when((F.col("class") == "live") & (F.col("__s.kind") >= 3), F.col("__s"))).alias("__more"),
        F.count_distinct(F.when(F.col("class") == "live", F.struct("__h1", "__h2"))).alias("n_live"),
        F.count_distinct(F.when(F.col("class") == "example", F.struct("__h1", "__h2"))).alias("n_example"))
    base = F.filter("__found", lambda x: x["kind"] < 3)
    more = F.coalesce(F.col("__more"), F.array().cast(SPAN))
    out = scanned.join(per_doc, ["__k1", "__k2"], "left").select(
        F.col("__id").alias(id_), base.alias("base"), F.concat(base, more).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    return out, values


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", count_of(F.col("base"), 0).alias("n_assign"), count_of(F.col("base"), 1).alias("n_access"),
        count_of(F.col("base"), 2).alias("n_hex"), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"), "n_live", "n_example")
