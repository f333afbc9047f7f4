"""Personal-data spans by weak supervision.

Candidates are all matches of the base patterns that are long enough to be personal data, and looser forms of the same
kinds.  Four labelers vote for, against or not at all on each: the base check (regex), published lists (gazetteer),
the words before the span (context), and the make-up of its digits (shape).  Votes are counted per kind and pattern over
the whole corpus; expectation-maximisation on these counts (their number is bounded by kinds x 3^labelers x lengths)
estimates how reliable each labeler is.  The posteriors then train a naive Bayes span classifier on votes, length and
form, which decides on the candidates that fail the base check.  Base spans always stay.

A null or empty text has no spans.  Repeated rows get the same spans.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import cut, table
from loadlens.llm.spans import count_of, find, joined

#: The kinds in their order, and the base patterns.  Runs are possessive and start where a run or the
#: previous match ends, which finds the same matches without rescanning.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser forms: written-out addresses, numbers in national form.
WRITTEN_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++"
                 r"(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++")
NATIONAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])?"
VALID_IP = rf"^(?=[0-9]){OCTET}\.(?=[0-9]){OCTET}\.(?=[0-9]){OCTET}\.(?=[0-9]){OCTET}$"

#: Gazetteers: common top-level domains, issuer prefixes of cards, calling codes.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|us|ca|au|jp|cn|in|br|nl|ch|at|be|pl|se|info|biz)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|69|85|87|88|96|97|99)"
SPECIAL_NETS = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
#: Words that speak for a kind, and words that speak for some other number.
FOR = (r"(?i)mail|contact|write", r"(?i)\bip\b|addr|host|server|client", r"(?i)card|visa|master|credit|payment|pan\b",
       r"(?i)phone|tel|call|mobile|fax|cell")
AGAINST = r"(?i)version|\bv$|isbn|order|invoice|serial|\bid\b|doi|\bno\b\.?\x20*$|#\x20*$"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits pass the check; from the right, every second digit is doubled."""
    backwards = F.split(F.reverse(digits(v)), "")
    total = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1))),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def valid_card(v: Column) -> Column:
    return F.when(F.length(digits(v)).between(14, 19), luhn(v)).otherwise(False)


def valid_phone(v: Column) -> Column:
    return F.length(digits(v)).between(10, 15)


def candidates(text: Column) -> Column:
    no = lambda v: F.lit(False)
    return F.concat(
        find(text, EMAIL, 0, lambda v: F.lit(True)),
        find(text, IP, 1, lambda v: v.rlike(VALID_IP)),
        find(text, CARD, 2, valid_card, lambda v: F.length(v) >= 12),
        find(text, PHONE, 3, valid_phone),
        find(text, WRITTEN_EMAIL, 0, no), find(text, NATIONAL_PHONE, 3, no))


def votes(s: Column) -> list[Column]:
    """For (1), against (-1) or no vote (0), of the four labelers."""
    kind, m, number = s["kind"], s["m"], digits(s["m"])
    say = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    by_kind = lambda *cols: F.element_at(F.array(*cols), kind + 1)
    yes = F.lit(True)
    regex = F.when(s["ok"], 1).when((kind == 1) | (kind == 2), -1).otherwise(0)
    gazetteer = by_kind(
        say(m.rlike(DOMAINS), ~m.rlike(DOMAINS)), say(~m.rlike(SPECIAL_NETS), m.rlike(SPECIAL_NETS)),
        say(number.rlike(ISSUERS), ~number.rlike(ISSUERS)), say(m.rlike(CALLING), m.startswith("+0")))
    context = say(by_kind(*[s["before"].rlike(p) for p in FOR]), s["before"].rlike(AGAINST))
    dull = number.rlike(r"(.)\1{6}") | number.rlike("0123456|1234567|7654321")
    shape = by_kind(F.lit(0), F.lit(0), say(F.length(number).isin(15, 16) & ~dull, dull), say(~dull & ~yes, dull))
    return [regex, gazetteer, context, shape]


def features(s: Column) -> list[Column]:
    """Bounded traits of a span: number of digits, and which separators it holds."""
    m = s["m"]
    form = (F.when(m.contains(" "), 1).otherwise(0) + F.when(m.contains("-"), 2).otherwise(0)
            + F.when(m.contains("("), 4).otherwise(0) + F.when(m.contains("."), 8).otherwise(0))
    return [F.least(F.length(digits(m)), F.lit(24)), form]


def fit(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int, int]], rounds: int = 50) -> dict[tuple, float]:
    """Posterior score of each (kind, votes, features) from rows (votes, features, kind, count).

    One expectation-maximisation per kind over two-sided labeler reliabilities, then naive Bayes on its soft labels.
    """
    scores: dict[tuple, float] = {}
    for kind in sorted({p[2] for p in patterns}):
        rows = [p for p in patterns if p[2] == kind]
        total = sum(n for *_, n in rows)
        post = [0.5 if not any(v) else (1 + sum(v) / sum(map(abs, v))) / 2 for v, *_ in rows]
        for _ in range(rounds):
            prior = (1 + sum(q * n for q, (*_, n) in zip(post, rows))) / (2 + total)
            hit = []
            for j in range(len(rows[0][0])):
                cell = defaultdict(lambda: 1.0)
                for q, (v, _, _, n) in zip(post, rows):
                    cell[1, v[j]] += q * n
                    cell[0, v[j]] += (1 - q) * n
                hit.append({(y, s): cell[y, s] / sum(cell[y, t] for t in (-1, 0, 1)) for y in (0, 1) for s in (-1, 0, 1)})
            post = []
            for v, *_ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(h[1, s] / h[0, s]) for h, s in zip(hit, v))
                post.append(1 / (1 + math.exp(-max(-500, min(500, odds)))))
        # Naive Bayes on soft labels: the votes again, and the traits.
        traits = [tuple(enumerate((*v, *f))) for v, f, *_ in rows]
        cell = defaultdict(float)
        values = defaultdict(set)
        for q, t, (*_, n) in zip(post, traits, rows):
            for j, x in t:
                cell[1, j, x] += q * n
                cell[0, j, x] += (1 - q) * n
                values[j].add(x)
        ones = sum(q * n for q, (*_, n) in zip(post, rows))
        for t, (v, f, _, _) in zip(traits, rows):
            odds = math.log((ones + 1) / (total - ones + 1))
            for j, x in t:
                odds += math.log((cell[1, j, x] + 1) / (ones + len(values[j])))
                odds -= math.log((cell[0, j, x] + 1) / (total - ones + len(values[j])))
            scores[(kind, *v, *f)] = 1 / (1 + math.exp(-max(-500, min(500, odds))))
    return scores


def find_personal(docs: DataFrame, id_: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """Documents with ``base`` and all ``spans`` (arrays of structs)."""
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = docs.select(F.col(id_).alias("__id"), candidates(body).alias("__found"))
    voted = F.transform("__found", lambda s: F.struct(
        s["kind"].alias("kind"), s["s"].alias("s"), s["e"].alias("e"), s["ok"].alias("ok"),
        F.array(s["kind"], *votes(s), *features(s)).alias("key")))
    scanned = cut(scanned.select("__id", voted.alias("__found")), "private-found")
    counts = scanned.where(F.size("__found") > 0).select(F.explode("__found.key").alias("key")).groupBy("key").count()
    # One row per kind, vote pattern and trait: at most a few thousand, whatever the corpus.
    patterns = [(tuple(r["key"][1:5]), tuple(r["key"][5:]), r["key"][0], r["count"]) for r in counts.collect()]
    scores = fit(sorted(patterns))
    good = [list(k) for k, p in sorted(scores.items()) if p >= threshold]
    base = F.filter("__found", lambda s: s["ok"])
    accepted = F.array(*[F.array(*[F.lit(x) for x in k]) for k in good]).cast("array<array<int>>")
    clear = lambda s: ~F.exists("__base", lambda b: (b["s"] < s["e"]) & (s["s"] < b["e"]))
    more = F.filter("__found", lambda s: ~s["ok"] & F.array_contains(accepted, s["key"]) & clear(s))
    rows = scanned.withColumn("__base", base)
    return rows.select(
        F.col("__id").alias(id_), F.col("__base").alias("base"), F.concat("__base", more).alias("spans"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"))
