"""What requests and responses say: bulk and multi-search lines, response metrics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loadlens.functions.template import display_template, json_document, trimmed

# Bulk actions in the order they are looked for.
BULK_ACTIONS = ("index", "create", "update", "delete")
DEFAULT_SIZE = 10

_ACTION_SCHEMA = ", ".join(f"{name} struct<_index: string>" for name in BULK_ACTIONS)

_METRICS = "took variant, hits struct<total: variant>, _shards variant"
# Only the named parts are materialised; the parser skips the documents a search returns.
# Parts of a response that only one operation has; elsewhere keys of these names are not looked at.
_PARTS = {
    "_bulk": ("items", "array<map<string, struct<_index: string, _shards: struct<total: bigint>>>>"),
    "_msearch": ("responses", "array<struct<took: variant, hits: struct<total: variant>, _shards: variant>>"),
}


def single_value(text: Column) -> Column:
    """Whether text is one JSON value and nothing after it; the parser itself stops after the first."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


# -- requests -------------------------------------------------------------------------------

def bulk_lines(rows: Column) -> Column:
    """Per line of a bulk body: the action it names (NULL if none) and its index."""

    def read(line: Column) -> Column:
        whole = F.when(line.rlike(r"^\s*\{.*\}\s*$") & single_value(line), line)
        return F.from_json(whole, _ACTION_SCHEMA)

    def name(parsed: Column) -> Column:
        action = F.coalesce(*[F.when(parsed[a].isNotNull(), F.lit(a)) for a in BULK_ACTIONS])
        index = F.coalesce(*[F.when(parsed[a].isNotNull(), F.coalesce(parsed[a]["_index"], F.lit(""))) for a in BULK_ACTIONS])
        return F.struct(action.alias("action"), index.alias("index"))

    return F.transform(F.transform(rows, read), name)


def bulk_doc_count(parsed: Column) -> Column:
    """Documents in a bulk body: every action, where all but 'delete' own the line that follows."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("document_next"))

    def step(state: Column, line: Column) -> Column:
        counts = ~state["document_next"] & line["action"].isNotNull()
        return F.struct(
            (state["n"] + F.when(counts, 1).otherwise(0)).alias("n"),
            (counts & (line["action"] != "delete")).alias("document_next"),
        )

    return F.aggregate(parsed, start, step, lambda state: state["n"])


def bulk_targets(parsed: Column) -> Column:
    """Distinct index names over all action-like lines, sorted; ['_all'] when none is named."""
    named = F.filter(F.transform(parsed, lambda line: line["index"]), lambda index: index.isNotNull() & (index != ""))
    found = F.sort_array(F.array_distinct(named))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("_all")))


def bulk_template(parsed: Column) -> Column:
    """Actions and targets as a template, '' when no line names an action."""
    actions = F.sort_array(F.array_distinct(
        F.filter(F.transform(parsed, lambda line: line["action"]), lambda action: action.isNotNull())
    ))
    text = F.to_json(F.struct(actions.alias("actions"), bulk_targets(parsed).alias("target")))
    return F.when(F.size(actions) > 0, display_template(text)).otherwise(F.lit(""))


def msearch_pairs(rows: Column) -> Column:
    """ARRAY<STRUCT<header, text, document>> of the usable (header, search) line pairs, in order."""
    starts = F.when(F.size(rows) >= 2, F.sequence(F.lit(0), F.size(rows) - 2, F.lit(2)))

    def pair(at: Column) -> Column:
        header, search = F.get(rows, at), F.get(rows, at + 1)
        return F.struct(
            json_document(header).alias("header"), F.btrim(search).alias("text"), json_document(search).alias("document")
        )

    usable = F.filter(F.transform(starts, pair), lambda p: p["header"].isNotNull() & p["document"].isNotNull())
    return F.coalesce(usable, F.array().cast("array<struct<header: variant, text: string, document: variant>>"))


def msearch_target(header: Column, otherwise: Column) -> Column:
    """Index of a sub-search: list joined, '_all' for an empty list, else the path's target."""
    listed = F.try_variant_get(header, "$[0].index", "array<string>")
    single = F.try_variant_get(header, "$[0].index", "string")
    return (
        F.when(listed.isNotNull(), F.when(F.size(listed) > 0, F.array_join(listed, ",")).otherwise(F.lit("_all")))
        .when(single.isNotNull() & (single != ""), single)
        .otherwise(otherwise)
    )


def requested_size(document: Column) -> Column:
    """Page size of a search; NULL when the body names one that is not a whole number."""
    present = F.try_variant_get(document, "$[0].size", "variant").isNotNull()
    value = F.try_variant_get(document, "$[0].size", "bigint")
    return F.when(present, value).otherwise(F.lit(DEFAULT_SIZE).cast("bigint"))


# -- responses ------------------------------------------------------------------------------

def response_text(text: Column) -> Column:
    """The one JSON object that a response is, without blanks around it; NULL if it is anything else."""
    body = trimmed(text)
    return F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")) & single_value(body), body)


def response_document(text: Column, operation: Column) -> Column:
    """Response as one struct for all operations, read by what the operation has; ``_mismatch`` if a part has another shape."""
    return response_parts(response_text(text), operation)


def response_parts(whole: Column, operation: Column) -> Column:
    """``response_document`` of a ``response_text``, which is best a column of its own: it is named once per operation."""

    def read(part: str = "", kind: str = "") -> Column:
        own = f"{part} {kind}, " if part else ""
        parsed = F.from_json(
            whole, f"{_METRICS}, updated variant, deleted variant, {own}_mismatch string", {"columnNameOfCorruptRecord": "_mismatch"})
        # The lambda names the parsed value, so that it is parsed once for all fields.
        shaped = F.transform(F.array(parsed), lambda r: F.struct(
            *[r[n].alias(n) for n in ("took", "hits", "_shards", "updated", "deleted", "_mismatch")],
            *[(r[n] if n == part else F.lit(None).cast(t)).alias(n) for n, t in _PARTS.values()]))
        return F.get(shaped, F.lit(0))

    out = None
    for name, part in _PARTS.items():
        out = F.when(operation == name, read(*part)) if out is None else out.when(operation == name, read(*part))
    return out.otherwise(read())


def _number(value: Column, path: str = "$", kind: str = "bigint") -> Column:
    return F.try_variant_get(value, path, kind)


def took_ms(response: Column) -> Column:
    return F.coalesce(_number(response["took"], kind="double"), F.lit(0.0))


def hits(response: Column) -> Column:
    return F.coalesce(_number(response["hits"]["total"], "$.value"), F.lit(0).cast("bigint"))


def hits_lower_bound(response: Column) -> Column:
    return F.coalesce(F.try_variant_get(response["hits"]["total"], "$.relation", "string") == "gte", F.lit(False))


def shards_total(response: Column) -> Column:
    return F.coalesce(_number(response["_shards"], "$.total"), F.lit(0).cast("bigint"))


def metrics_problem(response: Column) -> Column:
    """Why took, hits or shards of one response cannot be used; NULL when they can."""
    took, shards, total = response["took"], response["_shards"], response["hits"]["total"]

    def unusable(value: Column, path: str, kind: str) -> Column:
        found = F.try_variant_get(value, path, "variant")
        return found.isNotNull() & F.try_variant_get(value, path, kind).isNull()

    return (
        F.when(unusable(took, "$", "double"), F.lit("took is not a number"))
        .when(shards.isNotNull() & _number(shards, "$", "map<string,variant>").isNull(), F.lit("_shards is not an object"))
        .when(unusable(shards, "$.total", "bigint"), F.lit("_shards.total is not a number"))
        .when(unusable(total, "$.value", "bigint") & ~F.is_variant_null(F.try_variant_get(total, "$.value", "variant")),
              F.lit("hits.total.value is not a number"))
    )


def bulk_shards_total(items: Column) -> Column:
    """Shards of a bulk response: the first non-zero count of each index, added up."""
    results = F.flatten(F.transform(items, lambda item: F.map_values(item)))
    placed = F.transform(results, lambda result, at: F.struct(
        result["_index"].alias("index"), at.alias("at"), result["_shards"]["total"].alias("shards")
    ))
    counted = F.sort_array(F.filter(placed, lambda r: (r["index"] != "") & (r["shards"] != 0)))
    start = F.struct(F.lit("").alias("index"), F.lit(0).cast("bigint").alias("total"))
    total = F.aggregate(
        counted, start,
        lambda state, r: F.struct(
            r["index"].alias("index"),
            (state["total"] + F.when(r["index"] != state["index"], r["shards"]).otherwise(F.lit(0).cast("bigint"))).alias("total"),
        ),
        lambda state: state["total"],
    )
    return F.coalesce(total, F.lit(0).cast("bigint"))


def docs_affected(operation: Column, response: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return (
        F.when(operation == "_bulk", F.coalesce(F.size(response["items"]).cast("bigint"), zero))
        .when(operation == "_update_by_query", F.coalesce(_number(response["updated"]), zero))
        .when(operation == "_delete_by_query", F.coalesce(_number(response["deleted"]), zero))
        .otherwise(zero)
    )


def docs_problem(operation: Column, response: Column) -> Column:
    def unusable(value: Column) -> Column:
        return value.isNotNull() & _number(value).isNull()

    return F.when((operation == "_update_by_query") & unusable(response["updated"]), F.lit("updated is not a number")).when(
        (operation == "_delete_by_query") & unusable(response["deleted"]), F.lit("deleted is not a number")
    )
