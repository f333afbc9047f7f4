"""Clause counts and geo vertices of one query body, without leaving the row.

Counting needs to know where a key sits (a ``must`` right under a ``bool`` object, a list right
under ``terms``, an object inside an aggregation container).  The scrubbed body is cut into bracket
tokens - a run of list scalars is one token, so a list of 65,000 terms costs as much as a list of
two - and folded once with a stack of one-letter roles.  There is no join and no shuffle: a template
that holds a third of all traffic costs nothing extra.

Roles: R body · q query part · x elsewhere · b bool object · M S F X lists under must, should,
filter, must_not · t terms object · v list of terms · C aggregation container · N named aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loadlens.functions.template import SCALAR, STRING

# Clause key -> count it adds to.
KEYED_CLAUSES = {
    "bool": "bool",
    "fuzzy": "fuzzy",
    "geo_bounding_box": "geo_bbox",
    "geo_distance": "geo_distance",
    "geo_grid": "geo_bbox",
    "geo_polygon": "geo_shape",
    "geo_shape": "geo_shape",
    "knn": "knn",
    "nested": "nested",
    "prefix": "wildcard",
    "regexp": "wildcard",
    "script": "script",
    "wildcard": "wildcard",
}

_KEY = rf"{STRING}:"
_CLOSE = r"[}\]]++"

# Scrubbed body: skip separators and keys with a scalar, then take one token.
_BODY_TOKEN = (
    rf'(?s)(?:,|{_KEY}"\?")*+'
    rf'({_KEY}(?:\{{\}}|\[\]|[{{\[])|\{{\}}|\[\]|[{{\[]|{_CLOSE}|"\?"(?:,"\?")*+)'
)

_NUMBER = r'\[(?:-?[0-9][^,\[\]{}"]*+|true|false),'
_OPEN = rf"(?:\{{\}}|\[\]|{_NUMBER}|[{{\[])"
# Literal query: a list that starts with a number and goes on is one vertex token, '[n,'.
_GEO_TOKEN = (
    rf'(?s)(?:,|(?!"shape":){_KEY}{SCALAR}|{SCALAR}(?!:))*+'
    rf'({_KEY}{_OPEN}|"shape":{SCALAR}|{_OPEN}|{_CLOSE})'
)


def keyed_clauses(query_text: Column) -> Column:
    """Clause keys found anywhere in compact JSON text, with repeats."""
    names = "|".join(KEYED_CLAUSES)
    return F.regexp_extract_all(query_text, F.lit(rf'(?<!\\)"({names})":'), F.lit(1))


def count_keyed(found: Column, count: str) -> Column:
    keys = [key for key, name in KEYED_CLAUSES.items() if name == count]
    return F.size(F.filter(found, lambda key: key.isin(*keys)))


_COUNTS = ("must", "should", "filter", "must_not", "terms", "agg")
_BOOL_LISTS = {"must": "M", "should": "S", "filter": "F", "must_not": "X"}


def _shaped(token: Column) -> Column:
    """Token with what the fold asks about it, worked out once."""
    first, last = F.substring(token, 1, 1), F.substring(token, -1, 1)
    run = last == '"'
    closes = first.isin("}", "]")
    opens = last.isin("{", "[")
    return F.struct(
        token.alias("text"),
        F.when(closes, -F.length(token)).when(opens, 1).otherwise(0).alias("move"),
        (run | first.isin("{", "[")).alias("element"),
        F.when(run, ((F.length(token) + 1) / 4).cast("int")).otherwise(1).alias("size"),
        ((last == "{") | F.endswith(token, F.lit("{}"))).alias("object"),
    )


def nested_counts(scrubbed: Column) -> Column:
    """STRUCT<must, should, filter, must_not, terms, agg> of a scrubbed body."""
    tokens = F.transform(F.regexp_extract_all(scrubbed, F.lit(_BODY_TOKEN), F.lit(1)), _shaped)
    start = F.struct(
        F.lit("").alias("stack"),
        F.lit("").alias("top"),
        F.array(F.lit(0)).alias("base"),
        *[F.lit(0).alias(name) for name in _COUNTS],
    )

    def step(state: Column, token: Column) -> Column:
        stack, top = state["stack"], state["top"]
        text, move, element, size = token["text"], token["move"], token["element"], token["size"]
        kept = F.length(stack) + move
        closes, opens = move < 0, move > 0

        role = (
            F.when(top == "", "R")
            .when(top == "x", "x")
            .when(top.isin("R", "N") & text.isin('"aggs":{', '"aggregations":{'), "C")
            .when(top == "C", F.when(token["object"], "N").otherwise("x"))
            .when(top == "N", "x")
            .when(
                top == "R",
                F.when(text.isin('"query":{', '"query":[', '"script_fields":{', '"script_fields":['), "q").otherwise("x"),
            )
            .when(text == '"bool":{', "b")
            .when(text == '"terms":{', "t")
            .when((top == "t") & ~token["object"] & ~element, "v")
        )
        for name, letter in _BOOL_LISTS.items():
            role = role.when((top == "b") & (text == f'"{name}":['), letter)
        role = role.otherwise("q")

        def children(name: str, letter: str) -> Column:
            """Elements of the list under a bool key, or the single object there."""
            single = (top == "b") & text.isin(f'"{name}":{{', f'"{name}":{{}}')
            return F.when(element & (top == letter), state[name] + size).when(single, state[name] + 1).otherwise(state[name])

        # 'aggs' wins over 'aggregations' of the same object: forget what the latter added.
        wins = top.isin("R", "N") & text.isin('"aggs":{', '"aggs":[')
        agg = (
            F.when((top == "C") & token["object"], state["agg"] + 1)
            .when(wins, F.element_at(state["base"], -1))
            .otherwise(state["agg"])
        )
        return F.struct(
            F.when(closes, F.substr(stack, F.lit(1), kept)).when(opens, F.concat(stack, role)).otherwise(stack).alias("stack"),
            F.when(closes, F.substr(stack, kept, F.lit(1))).when(opens, role).otherwise(top).alias("top"),
            F.when(closes, F.slice(state["base"], F.lit(1), kept + 1))
            .when(opens, F.array_append(state["base"], agg))
            .otherwise(state["base"]).alias("base"),
            *[children(name, letter).alias(name) for name, letter in _BOOL_LISTS.items()],
            F.when(element & (top == "v"), state["terms"] + size).otherwise(state["terms"]).alias("terms"),
            agg.alias("agg"),
        )

    counted = F.aggregate(
        tokens, start, step, lambda state: F.struct(*[state[name].alias(name) for name in _COUNTS])
    )
    zero = F.struct(*[F.lit(0).alias(name) for name in _COUNTS])
    return F.when(scrubbed.rlike(r'"(?:bool|terms|aggs|aggregations)":\{'), counted).otherwise(zero)


def geo_vertices(query_text: Column) -> Column:
    """STRUCT<vertices, malformed> over compact JSON text of the query part.

    Roles: q anywhere · G geo_shape or geo_polygon object · F field object below it · S its shape ·
    c coordinates · d inside a counted vertex.
    """
    tokens = F.regexp_extract_all(query_text, F.lit(_GEO_TOKEN), F.lit(1))
    start = F.struct(
        F.lit("").alias("stack"), F.array(F.lit(0)).alias("base"),
        F.lit(0).alias("n"), F.lit(False).alias("malformed"),
    )

    def step(state: Column, token: Column) -> Column:
        stack, top = state["stack"], F.right(state["stack"], F.lit(1))
        first, last = F.left(token, F.lit(1)), F.right(token, F.lit(1))
        closing = first.isin("}", "]")
        pushes = last.isin("{", "[", ",")
        element = first.isin("{", "[")
        is_list = last.isin("[", ",")
        vertex = last == ","
        coordinates = top.isin("F", "S") & F.startswith(token, F.lit('"coordinates":')) & is_list
        shape = (top == "F") & F.startswith(token, F.lit('"shape":'))
        point = vertex & (coordinates | (element & (top == "c")))
        role = (
            F.when(point, "d")
            .when(coordinates, "c")
            .when(element & is_list & top.isin("c", "d"), top)
            .when(shape & (last == "{"), "S")
            .when((top == "G") & (last == "{"), "F")
            .when(token.isin('"geo_shape":{', '"geo_polygon":{'), "G")
            .otherwise("q")
        )
        # A field with a 'shape' counts the shape only, not coordinates next to it.
        n = F.when(point, state["n"] + 1).when(shape, F.element_at(state["base"], -1)).otherwise(state["n"])
        kept = F.length(stack) - F.length(token)
        return F.struct(
            F.when(closing, F.left(stack, kept)).when(pushes, F.concat(stack, role)).otherwise(stack).alias("stack"),
            F.when(closing, F.slice(state["base"], F.lit(1), kept + 1))
            .when(pushes, F.array_append(state["base"], n))
            .otherwise(state["base"]).alias("base"),
            n.alias("n"),
            (state["malformed"] | (shape & ~F.regexp_like(token, F.lit(r"\{\}?$")))).alias("malformed"),
        )

    counted = F.aggregate(
        tokens, start, step,
        lambda s: F.struct(s["n"].alias("vertices"), s["malformed"].alias("malformed")),
    )
    zero = F.struct(F.lit(0).alias("vertices"), F.lit(False).alias("malformed"))
    return F.when(query_text.rlike(r'"geo_(?:shape|polygon)":\{'), counted).otherwise(zero)
