"""Tables with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node long, key string, __k1 long, "
          "__row string, component long, names string")


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    base = words(1, 120)
    texts = [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (3, base.replace("a", "e", 2), None), (None, base, "a"),
        (4, None, "a"), (5, "", "b"), (6, " \n\t ", None), (7, "x" * 200_000, "a"), (8, words(2, 30_000), "b"),
        (9, "one two", "a"), (10, "one two", "a"), (11, None, None), (None, None, None), (12, words(3, 40) + "\n" + base, "c"),
        (12, words(4, 40), "c"), (13, "é\U0001f600 mail a@b.com  +1 (555) 555-0100 x", "a"),
    ]
    return [(i, t, "en", s, 0, 1, "k", 2, "r", 3, "n") for i, t, s in texts]


def docs(spark, keep=lambda r: True):
    return spark.createDataFrame([r for r in rows() if keep(r)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
