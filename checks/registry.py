"""Registered queries: each derives the request log from the given tables and runs one operator over all of it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import stored
from loadlens.operators import baselines as B, latency as L, metrics as M, summary as S
from loadlens.operators.records import analyze, build_records, dedupe_msearch, split_dead_letters
from loadlens.plans import catalog as C, health as H, panels as P
from loadlens.plans.filters import Filters
from loadlens.schema import CLAUSES, INDICATORS
from loadlens.session import configure
from loadlens.sources import latency_samples, metric_samples
from loadlens.sources.decompression import decompress_bodies
from loadlens.sources.request_log import request_log

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 7


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floats rounded: the last digits of a distributed sum depend on task order."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The derived log is plain text, so the Python stage for compressed bodies is left out here.
    return build_records(request_log(configure(spark), sf_dir), decompress=False)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_dead_letters(analyze(request_log(configure(spark), sf_dir), decompress=False))[1]


def _over_records(panel) -> Query:
    return lambda spark, sf_dir: rounded(panel(records(spark, sf_dir)))


def _over_dead_letters(panel) -> Query:
    return lambda spark, sf_dir: rounded(panel(dead_letters(spark, sf_dir)))


# -- record columns -------------------------------------------------------------------------

_WHO = ("timestamp", "request_path", "identity_client_host", "msearch_sub_query_index")


def _identity(r: DataFrame) -> DataFrame:
    return r.select(
        *_WHO, "identity_username", "identity_applicative_provider", "identity_user_agent", "cluster_name",
        F.coalesce(F.try_element_at("identity_labels", F.lit("team")), F.lit("")).alias("label_team"),
        F.coalesce(F.try_element_at("identity_labels", F.lit("env")), F.lit("")).alias("label_env"),
    )


def _stress(r: DataFrame) -> DataFrame:
    components = [c for c in r.columns if c.startswith("stress_components_")]
    return r.select(
        *_WHO, "stress_score", "stress_base", "stress_multiplier", *components, "stress_cost_indicator_count",
        F.array_join("stress_cost_indicator_names", ",").alias("names"),
        F.array_join(F.map_keys("stress_bonuses"), ",").alias("bonus_keys"),
    )


RECORD_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "record_identity": _identity,
    "record_request": lambda r: r.select(
        *_WHO, "request_method", "request_operation", "request_target", "request_template", "request_body",
        "request_size_bytes", "request_size", "request_geo_vertex_count", "request_bulk_doc_count"),
    "record_response": lambda r: r.select(
        *_WHO, "response_status", "response_es_took_ms", "response_gateway_took_ms", "response_hits",
        "response_shards_total", "response_docs_affected", "response_size_bytes"),
    "record_clauses": lambda r: r.select(*_WHO, *[f"clause_counts_{n}" for n in CLAUSES]),
    "record_indicators": lambda r: r.select(*_WHO, *[f"cost_indicators_{n}" for n in INDICATORS]),
    "record_stress": _stress,
    "record_msearch": lambda r: r.where("request_operation = '_msearch'").select(
        *_WHO, "msearch_batch_size", "request_target", "request_template", "response_hits"),
    "record_msearch_ids": lambda r: r.where("request_operation = '_msearch'").select(*_WHO, "msearch_request_id"),
    "msearch_parents": lambda r: dedupe_msearch(r).groupBy("request_operation").agg(
        F.sum("request_size_bytes").alias("request_bytes"), F.count(F.lit(1)).alias("requests")),
}

# -- filters --------------------------------------------------------------------------------

_WEEK = (datetime(2024, 1, 8), datetime(2024, 1, 15))

FILTERED: dict[str, tuple[Filters, Callable[[DataFrame], DataFrame]]] = {
    "filter_week": (Filters(*_WEEK), C.RECORD_PANELS["top_applications"]),
    "filter_dimensions": (
        Filters(dims={"operation": ["_search", "_count"], "cluster": ["east", "west"]}), C.RECORD_PANELS["top_indices"]),
    "filter_indicators": (
        Filters(dims={"cost_indicator": ["has_script", "has_geo"]}), C.RECORD_PANELS["pie_cost_indicator"]),
    "filter_label": (Filters(labels={"team": "team-2"}), C.RECORD_PANELS["pie_operation"]),
    "filter_drill": (Filters(extra="response_status >= 400").drill("operation", "_update_by_query"), C.RECORD_PANELS["by_status"]),
}

# -- summary --------------------------------------------------------------------------------


def _partial_states(r: DataFrame) -> DataFrame:
    """Two batches of partial states, as two inserts would leave them."""
    late = F.col("response_status") >= 400
    return S.summary_states(r.where(~late)).unionByName(S.summary_states(r.where(late)))


def _no_sketches(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("pct_")])


def _summary_states(r: DataFrame) -> DataFrame:
    states = S.summary_states(r)
    means = [c for c in states.columns if c.startswith("avg_")]
    flat = [F.col(c)[part].alias(f"{c}_{part}") for c in means for part in ("sum", "n")]
    return states.select("time_bucket", *S.SUMMARY_DIMS[1:], "count_state", "sum_score_state", *flat)


SUMMARY_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "summary_states": _summary_states,
    "summary_finalized": lambda r: _no_sketches(S.finalize_states(_partial_states(r))),
    "summary_merged_daily": lambda r: _no_sketches(
        S.finalize_states(S.merge_daily(_partial_states(r), ("request_operation", "cluster_name")),
                          ("time_bucket", "request_operation", "cluster_name"))),
    "summary_trend_application": lambda r: S.summary_trend(_partial_states(r), C.APPLICATION, n=5),
    "summary_trend_total": lambda r: S.summary_trend(_partial_states(r), None, "sum", "stress_score"),
    # Sketch percentiles, checked to lie near the exact ones; the sketch itself is not comparable.
    "summary_percentiles": lambda r: _sketch_error(r),
}


def _sketch_error(r: DataFrame) -> DataFrame:
    """Per operation: share of records at or below the sketch's median, within 5 points of one half."""
    sketched = S.summary_states(r).groupBy("request_operation").agg(
        S.finalised("percentile_50", "stress_score").alias("median"))
    # Operations are few: one row each, from an aggregate.
    return (
        r.select("request_operation", "stress_score").join(sketched, "request_operation")
        .groupBy("request_operation")
        .agg(F.avg((F.col("stress_score") <= F.col("median")).cast("double")).alias("below"),
             F.avg((F.col("stress_score") < F.col("median")).cast("double")).alias("under"))
        .select("request_operation", ((F.col("below") >= 0.45) & (F.col("under") <= 0.55)).alias("median_holds"))
    )


# -- ranges beyond raw retention, and bins from the range --------------------------------------

_NOW = datetime(2024, 1, 20, 10, 30)
_RANGES = {"all": Filters(), "day": Filters(datetime(2024, 1, 9), datetime(2024, 1, 10))}


def _routed(r: DataFrame, name: str) -> DataFrame:
    """Raw rows older than three days have expired, and the summary has all hours; the panel shows both sides of the border."""
    kept = r.where(F.col("timestamp") >= F.lit(_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS"))
    return C.run_panel(name, kept, Filters(start=datetime(2024, 1, 5)), _partial_states(r), _NOW)


# -- baselines ------------------------------------------------------------------------------

_AT = datetime(2024, 1, 10, 12, 0)


def _scored_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against the hour before each request instead of static baselines."""
    log = request_log(configure(spark), sf_dir)
    ticks = B.asof_baselines(build_records(log, decompress=False))
    scored = build_records(log, baselines=ticks, decompress=False)
    return _took_and_shards(scored)


def _took_and_shards(scored: DataFrame) -> DataFrame:
    return rounded(scored.groupBy("request_operation").agg(
        F.sum("stress_components_took").alias("took"), F.sum("stress_components_shards").alias("shards"),
        F.count(F.lit(1)).alias("n")), 2)


def _late_columns(r: DataFrame) -> DataFrame:
    """What columns that older files lack hold now: a default in old rows, their values in new ones."""
    zero = F.col("from_old") & (F.col("request_bulk_doc_count") != 0)
    return r.groupBy("request_operation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("not_default"),
        F.count_if(F.col("request_bulk_doc_count").isNull() | F.col("stress_components_bulk_doc_count").isNull()).alias("missing"))


# -- compressed bodies ----------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _wrap(texts):
    import base64
    import gzip

    return texts.map(lambda text: "gzip+b64:" + base64.b64encode(gzip.compress(text.encode(), 1)).decode())


def compressed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, packed as a gateway would and unpacked again."""
    documents = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    packed = documents.select("doc_id", _wrap("text").alias("request_body"))
    back = decompress_bodies(packed, ("request_body",))
    return back.select("doc_id", F.octet_length("request_body").alias("bytes"), F.md5(F.encode("request_body", "UTF-8")).alias("digest"))


def truncated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut to at most 1000 bytes on a character boundary."""
    from loadlens.functions.text import is_truncated, truncate_utf8

    documents = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(
        "doc_id", is_truncated(F.col("text"), 1000).cast("int").alias("cut"),
        F.octet_length(truncate_utf8(F.col("text"), 1000)).alias("bytes"),
        F.md5(F.encode(truncate_utf8(F.col("text"), 1000), "UTF-8")).alias("digest"),
    )


# -- table of all ---------------------------------------------------------------------------


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update({name: _over_records(panel) for name, panel in C.RECORD_PANELS.items()})
    out.update({name: _over_records(view) for name, view in RECORD_VIEWS.items()})
    out.update({name: _over_records(view) for name, view in SUMMARY_VIEWS.items()})
    out.update({name: _over_dead_letters(panel) for name, panel in C.DEAD_LETTER_PANELS.items()})
    out.update({
        name: _over_records(lambda r, f=filters, p=panel: p(f.apply(r))) for name, (filters, panel) in FILTERED.items()
    })
    out.update({
        name: _over_records(lambda r, n=name: C.dual(r, S.summary_states(r), n)) for name in C.DUAL_PANELS
    })
    out.update({
        f"variable_{name}": _over_records(lambda r, n=name: C.variable(r, S.summary_states(r), n, datetime(2024, 1, 31)))
        for name in C.DIMENSIONS
    })
    out["status_by_operation_wide"] = _over_records(
        lambda r: P.wide(C.RECORD_PANELS["status_by_operation"](r), ["_search/200", "_bulk/201", "_msearch/200"]))
    out.update({f"routed_{name}": _over_records(lambda r, n=name: _routed(r, n)) for name in C.DUAL_PANELS})
    out.update({f"auto_bins_{name}": _over_records(lambda r, f=filters: C.run_panel("trend_operation", r, f, every=None, n=3))
                for name, filters in _RANGES.items()})
    out["baseline_trailing"] = _over_records(lambda r: B.trailing_baselines(r, _AT))
    out["baseline_asof"] = _over_records(lambda r: B.asof_baselines(r))
    out["scored_asof"] = _scored_asof
    out["compressed_bodies"] = compressed_bodies
    out["truncated_bodies"] = truncated_bodies
    out.update({
        # Interpolated quantiles are often short decimals: round them beyond where ties fall.
        name: (lambda spark, sf_dir, p=panel, d=10 if name == "analyzer_latency" else DIGITS: rounded(
            p(metric_samples.samples(configure(spark), sf_dir)), d))
        for name, panel in H.PANELS.items()
    })
    out.update({
        name: (lambda spark, sf_dir, p=report: rounded(p(latency_samples.samples(configure(spark), sf_dir))))
        for name, report in L.REPORTS.items()
    })
    view = RECORD_VIEWS
    out["scanned_requests"] = stored.scanned(lambda r: rounded(view["record_request"](r)))
    out["scanned_plain_responses"] = stored.scanned(lambda r: rounded(view["record_response"](r)), decompress=False)
    out["streamed_responses"] = stored.streamed("records", lambda r: rounded(view["record_response"](r)))
    out["streamed_dead_letters"] = stored.streamed("dead_letters", C.DEAD_LETTER_PANELS["dlq_count"])
    out["streamed_summary"] = stored.streamed("summary", lambda s: rounded(_no_sketches(S.finalize_states(s))))
    out["delivered_twice"] = stored.delivered_twice("records", lambda r: rounded(view["record_request"](r)))
    out["live_hours"] = lambda spark, sf_dir: rounded(stored.live("10 days")(spark, sf_dir))
    out["scored_by_feedback"] = stored.scored_by_feedback(_AT, _took_and_shards)
    out["mixed_versions"] = stored.mixed_versions(_late_columns)
    out["retained_requests"] = stored.retained(_NOW, lambda r: rounded(view["record_request"](r)))
    out["catalogued_requests"] = stored.catalogued(_NOW, 5, lambda r: rounded(view["record_request"](r)))
    out["array_batches"] = stored.array_batches
    out["tabled_requests"] = stored.tabled("records", lambda r: rounded(view["record_request"](r)))
    out["tabled_dead_letters"] = stored.tabled("dead_letters", C.DEAD_LETTER_PANELS["dlq_count"])
    out["compacted_summary"] = stored.compacted_summary(lambda s: rounded(_no_sketches(S.finalize_states(s))))
    out["write_integrity"] = lambda spark, sf_dir: latency_samples.integrity_report(configure(spark), sf_dir)
    return out
