"""Payload -> wide record.

One narrow stage: parse, fan out, count, score.  No shuffle and no join, so neither a hot template
nor a hot client can skew it, and the same function serves batch and streaming input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions import bodies, identity, paths
from loadlens.functions.structure import KEYED_CLAUSES, count_keyed, geo_vertices, keyed_clauses, nested_counts
from loadlens.functions.template import canonical_json, display_template, json_document, scrub
from loadlens.functions.text import MAX_BODY_BYTES, is_truncated, lines, seconds_to_ms, truncate_to_ms, truncate_utf8, whole_number
from loadlens.operators.baselines import join_baselines
from loadlens.operators.scoring import DEFAULT_MODEL, QUERY_OPERATIONS, ScoringModel, with_cost_indicators, with_stress
from loadlens.schema import DEAD_LETTER, RECORD
from loadlens.session import built_once, held
from loadlens.sources.decompression import decompress_bodies
from loadlens.sources.payloads import clean_payload, recover_text


def _big(value: int = 0) -> Column:
    return F.lit(value).cast("bigint")


def _section(document: Column, name: str) -> Column:
    """Compact text of one top-level part of a body."""
    return F.to_json(F.try_variant_get(document, f"$[0].{name}", "variant"))


def with_operation(df: DataFrame) -> DataFrame:
    """Operation, path target and gateway time of a clean payload."""
    return df.withColumns({
        "request_operation": paths.operation(F.col("method"), F.col("path")),
        "path_target": paths.target(F.col("path")),
        "response_gateway_took_ms": seconds_to_ms(F.col("upstream_response_time")),
        "request_size_bytes": whole_number(F.col("content_length")),
    })


@built_once
def _parsed_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    operation = F.col("request_operation")
    plain = ~operation.isin("_bulk", "_msearch")
    # Lines and the response's text are made in a step of their own: what follows refers to them many times.
    split = {"rows": F.when(~plain, lines(F.col("request_body"))), "response_text": bodies.response_text(F.col("response_body"))}
    return split, {
        "response": bodies.response_parts(F.col("response_text"), operation),
        "document": F.when(plain, json_document(F.col("request_body"))),
        "bulk": F.when(operation == "_bulk", bodies.bulk_lines(F.col("rows"))),
        "pairs": F.when(operation == "_msearch", bodies.msearch_pairs(F.col("rows"))),
    }


def with_parsed_bodies(df: DataFrame) -> DataFrame:
    """Parse each body once: the response into its metrics, the request by what its operation needs."""
    split, parsed = _parsed_columns()
    return df.withColumns(split).withColumns(parsed)


@built_once
def _problem_columns(max_body_bytes: int) -> tuple[Column, Column]:
    operation, response = F.col("request_operation"), F.col("response")
    mismatch = response["_mismatch"].isNotNull() & F.try_parse_json(F.col("response_body")).isNotNull()
    sub_problems = F.filter(
        F.transform(
            F.slice(response["responses"], F.lit(1), F.greatest(F.size("pairs"), F.lit(0))), bodies.metrics_problem
        ),
        lambda problem: problem.isNotNull(),
    )
    size = bodies.requested_size(F.col("document"))
    problem = F.coalesce(
        F.col("scan_error"),
        F.when(mismatch, F.lit("response has an unexpected shape")),
        F.when(operation == "_msearch", F.get(sub_problems, F.lit(0))).otherwise(
            F.coalesce(
                bodies.metrics_problem(response),
                bodies.docs_problem(operation, response),
                F.when((operation == "_search") & size.isNull(), F.lit("size is not a whole number")),
            )
        ),
    )
    payload = F.to_json(F.struct(
        "method", "path", "headers", "request_body", "response_body", "response_status", "upstream_response_time",
        "content_length", "response_size_bytes", "client_host", "cluster_name",
    ))
    return problem, F.when(F.col("error").isNotNull(), truncate_utf8(payload, max_body_bytes))


def with_problem(df: DataFrame, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """``error``: why the request cannot become a record, NULL when it can; ``raw``: the payload then."""
    error, raw = _problem_columns(max_body_bytes)
    return df.withColumn("error", error).withColumn("raw", raw)


def _metrics(response: Column) -> dict[str, Column]:
    return {
        "response_es_took_ms": bodies.took_ms(response),
        "response_hits": bodies.hits(response),
        "hits_lower_bound": bodies.hits_lower_bound(response),
        "response_shards_total": bodies.shards_total(response),
    }


def _opens() -> Column:
    return (F.col("request_operation") == "_msearch") & F.col("error").isNull()


@built_once
def _part_columns() -> list[Column]:
    """What a record takes from its sub-search (``at``, ``pair``) or, where none is opened, from the whole request."""
    operation, response, gateway = F.col("request_operation"), F.col("response"), F.col("response_gateway_took_ms")
    is_bulk, opens = operation == "_bulk", _opens()
    target, pair, at = F.col("path_target"), F.col("pair"), F.col("at")
    single = _metrics(response)
    single["response_es_took_ms"] = F.when(is_bulk & (gateway > 0), gateway).otherwise(single["response_es_took_ms"])
    single["response_shards_total"] = F.when(is_bulk, bodies.bulk_shards_total(response["items"])).otherwise(
        single["response_shards_total"]
    )
    # Deterministic, so that a retried batch yields the same records.
    request_id = F.left(
        F.sha2(F.concat_ws("\u0001", "event_time", "client_host", "path", "request_body").cast("binary"), 256), F.lit(12)
    )
    parts = {
        "msearch_request_id": (request_id, F.lit("")),
        "msearch_batch_size": (F.size("pairs"), F.lit(0)),
        "msearch_sub_query_index": (at, F.lit(0)),
        "request_target": (
            bodies.msearch_target(pair["header"], target),
            F.when(is_bulk & (target == "_all"), F.array_join(bodies.bulk_targets(F.col("bulk")), ",")).otherwise(target),
        ),
        "body": (
            F.when(F.regexp_like(pair["text"], F.lit(r"^\{\s*\}$")), F.lit("")).otherwise(pair["text"]),
            F.col("request_body"),
        ),
        "query_document": (pair["document"], F.col("document")),
        **{name: (column, single[name]) for name, column in _metrics(F.get(response["responses"], at)).items()},
        "response_docs_affected": (_big(), bodies.docs_affected(operation, response)),
        "request_bulk_doc_count": (_big(), F.when(is_bulk, bodies.bulk_doc_count(F.col("bulk"))).otherwise(_big())),
        "bulk_template": (F.lit(None).cast("string"), F.when(is_bulk, bodies.bulk_template(F.col("bulk")))),
    }
    return [F.when(opens, part).otherwise(whole).alias(name) for name, (part, whole) in parts.items()]


def fan_out(df: DataFrame) -> DataFrame:
    """One row per record: a multi-search opens into its usable sub-searches, the rest pass through."""
    kind = df.schema["pairs"].dataType
    pairs = F.when(_opens(), F.col("pairs")).otherwise(F.array(F.lit(None).cast(kind.elementType)))
    return df.select("*", F.posexplode(pairs).alias("at", "pair")).select(
        "event_time", "method", "path", "headers", "client_host", "cluster_name", "response_status",
        "response_size_bytes", "request_operation", "response_gateway_took_ms", "request_size_bytes", "error", "raw",
        *_part_columns(),
    )


@built_once
def _structure_columns(max_body_bytes: int) -> tuple[dict[str, Column], ...]:
    document = F.col("query_document")
    counted = F.col("request_operation").isin(*QUERY_OPERATIONS)
    texts = {
        "scrubbed": scrub(canonical_json(document)),
        "query_text": F.when(counted, _section(document, "query")),
        "fields_text": F.when(counted, _section(document, "script_fields")),
    }
    found = {
        "keyed": F.concat(
            F.coalesce(keyed_clauses(F.col("query_text")), F.array().cast("array<string>")),
            F.coalesce(keyed_clauses(F.col("fields_text")), F.array().cast("array<string>")),
        ),
        "inside": F.when(counted, nested_counts(F.col("scrubbed"))),
        "geo": F.when(counted, geo_vertices(F.col("query_text"))),
        "top_knn": (counted & F.try_variant_get(document, "$[0].knn", "variant").isNotNull()).cast("int"),
        "runtime": F.when(
            counted,
            F.size(F.map_keys(F.try_variant_get(document, "$[0].runtime_mappings", "map<string,variant>"))),
        ),
    }
    inside, zero = F.col("inside"), F.lit(0)
    counts = {name: count_keyed(F.col("keyed"), name) for name in sorted(set(KEYED_CLAUSES.values()))}
    counts["knn"] = counts["knn"] + F.coalesce(F.col("top_knn"), zero)
    for child in ("must", "should", "filter", "must_not"):
        counts[f"bool_{child}"] = F.coalesce(inside[child], zero)
    counts["terms_values"] = F.coalesce(inside["terms"], zero)
    counts["agg"] = F.coalesce(inside["agg"], zero)
    counts["runtime_mapping"] = F.coalesce(F.col("runtime"), zero)
    out = {f"clause_counts_{name}": column for name, column in counts.items()}
    out["request_template"] = F.coalesce(F.col("bulk_template"), display_template(F.col("scrubbed")))
    out["request_geo_vertex_count"] = F.coalesce(F.col("geo")["vertices"], zero).cast("bigint")
    # Found out only here: the request may be a part of a multi-search, so what is kept is this part.
    bad_geo = F.col("error").isNull() & F.col("geo")["malformed"]
    part = F.to_json(F.struct("method", "path", "headers", F.col("body").alias("request_body"), "client_host", "cluster_name"))
    out["raw"] = F.when(bad_geo, truncate_utf8(part, max_body_bytes)).otherwise(F.col("raw"))
    out["error"] = F.when(bad_geo, F.lit("geo shape is not an object")).otherwise(F.col("error"))
    return texts, found, out


def with_structure(df: DataFrame, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Template, clause counts and geo vertices of the query body."""
    texts, found, out = _structure_columns(max_body_bytes)
    return held(df.withColumns(texts).withColumns(found), *found).withColumns(out)


@built_once
def _identity_columns() -> dict[str, Column]:
    headers = F.col("headers")
    return {
        "identity_username": identity.username(headers),
        "identity_applicative_provider": identity.applicative_provider(headers),
        "identity_user_agent": identity.user_agent(headers),
        "identity_labels": identity.labels(headers),
    }


@built_once
def _request_columns(max_body_bytes: int) -> dict[str, Column]:
    size = F.when(
        F.col("request_operation") == "_search", bodies.requested_size(F.col("query_document"))
    ).otherwise(_big())
    made = {
        "timestamp": truncate_to_ms(F.col("event_time")),
        "identity_client_host": F.col("client_host"),
        "request_method": F.col("method"),
        "request_path": F.col("path"),
        "request_body": truncate_utf8(F.col("body"), max_body_bytes),
        "request_body_truncated": is_truncated(F.col("body"), max_body_bytes).cast("int"),
        "request_size": F.coalesce(size, _big()),
        "response_status": F.col("response_status").cast("int"),
        **_identity_columns(),
    }
    return {name: column.alias(name) for name, column in made.items()}


@built_once
def _record_columns() -> list[Column]:
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields]
    return [*typed, F.col("error"), F.col("raw")]


def analyze(
    payloads: DataFrame,
    model: ScoringModel | None = None,
    baselines: DataFrame | None = None,
    decompress: bool = True,
    max_body_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """All record columns plus ``error`` and ``raw``.

    ``baselines`` is a frame from ``loadlens.operators.baselines``: one row, or one row per minute.
    ``decompress=False`` skips the Python stage when bodies are known to be plain text.
    ``max_body_bytes`` limits stored bodies and dead-letter payloads, nothing else; 0 keeps them whole.
    """
    model = model or DEFAULT_MODEL
    df = clean_payload(recover_text(payloads, bodies=not decompress))
    if decompress:
        df = decompress_bodies(df)
    df = fan_out(with_problem(with_parsed_bodies(with_operation(df)), max_body_bytes))
    df = with_structure(df, max_body_bytes)
    made = _request_columns(max_body_bytes)
    kept = [c for c in df.columns if c in RECORD.names and c not in made]
    df = df.select(*made.values(), *kept, "hits_lower_bound", "error", "raw")
    df = with_stress(with_cost_indicators(join_baselines(df, baselines), model), model)
    return df.select(*_record_columns())


def split_dead_letters(analyzed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters): a row with an error or without a known operation is a dead letter."""
    known = F.col("request_operation").isNotNull() & (F.col("request_operation") != "unknown")
    good = F.col("error").isNull() & known
    records = analyzed.where(good).select(*RECORD.names)
    dead = analyzed.where(~good | good.isNull()).select(
        "timestamp", "cluster_name", F.coalesce("error", F.lit("unknown operation")).alias("error"),
        F.coalesce("raw", F.lit("")).alias("raw"), "request_path", "request_method", F.lit("").alias("request_body"),
    )
    return records, dead.select(*DEAD_LETTER.names)


def build_records(payloads: DataFrame, **options) -> DataFrame:
    """Records only; see ``analyze`` for the options."""
    return split_dead_letters(analyze(payloads, **options))[0]


def dedupe_msearch(records: DataFrame) -> DataFrame:
    """Keep one record per multi-search.

    Sub-searches repeat the size and gateway time of their parent, so sums of those count it once
    per sub-search; this is the view to sum over instead.
    """
    return records.where(F.col("msearch_sub_query_index") == 0)
