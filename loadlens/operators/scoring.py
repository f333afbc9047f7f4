"""The stress model: cost indicators, bonuses and weighted scores, declared as data and compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.schema import COMPONENTS
from loadlens.session import built_once

PRECISION = 4

# Operations whose body is a query and is therefore counted.
QUERY_OPERATIONS = (
    "_search", "_msearch", "_count", "_explain", "_validate", "_update_by_query", "_delete_by_query",
)
_BOOL_CHILDREN = ("bool_must", "bool_should", "bool_filter", "bool_must_not")


@dataclass(frozen=True)
class Baselines:
    """What one unit of each measure is."""

    took_ms: float = 100.0
    hits: float = 500.0
    shards_total: float = 5.0
    docs_affected: float = 500.0


@dataclass(frozen=True)
class Indicator:
    """Fires when the sum of its counts reaches the threshold."""

    name: str
    counts: tuple[str, ...]
    threshold: int
    multiplier: float


@dataclass(frozen=True)
class Bonus:
    """min(weight * ln(1 + n - threshold), cap) for n above the threshold."""

    key: str
    counts: tuple[str, ...]
    threshold: int
    weight: float
    cap: float


@dataclass(frozen=True)
class Formula:
    operations: tuple[str, ...]
    weights: dict[str, float]


# Component -> (measure, baseline).
_INPUTS = {
    "took": ("response_es_took_ms", "took_ms"),
    "shards": ("response_shards_total", "shards_total"),
    "hits": ("response_hits", "hits"),
    "docs_affected": ("response_docs_affected", "docs_affected"),
    "bulk_doc_count": ("request_bulk_doc_count", "docs_affected"),
}

# Fixed values of the default model.
_INDICATORS = (
    Indicator("has_script", ("script",), 1, 1.5),
    Indicator("has_runtime_mapping", ("runtime_mapping",), 1, 1.5),
    Indicator("has_wildcard", ("wildcard",), 1, 1.3),
    Indicator("has_nested", ("nested",), 1, 1.3),
    Indicator("has_fuzzy", ("fuzzy",), 1, 1.2),
    Indicator("has_geo", ("geo_distance", "geo_shape"), 1, 1.2),
    Indicator("has_knn", ("knn",), 1, 1.2),
    Indicator("excessive_bool", _BOOL_CHILDREN, 50, 1.3),
    Indicator("large_terms_list", ("terms_values",), 500, 1.2),
    Indicator("deep_aggs", ("agg",), 10, 1.3),
    Indicator("unbound_hits", ("hits_lower_bound",), 1, 1.3),
)
_BONUSES = (
    Bonus("bool_total", _BOOL_CHILDREN, 4, 0.10, 0.50),
    Bonus("agg_clause_count", ("agg",), 3, 0.10, 0.50),
    Bonus("wildcard_clause_count", ("wildcard",), 1, 0.10, 0.50),
    Bonus("nested_clause_count", ("nested",), 1, 0.10, 0.50),
    Bonus("fuzzy_clause_count", ("fuzzy",), 1, 0.10, 0.50),
    Bonus("geo_vertex_count", ("geo_vertex",), 10, 0.12, 0.60),
    Bonus("knn_clause_count", ("knn",), 1, 0.10, 0.50),
    Bonus("script_clause_count", ("script",), 1, 0.10, 0.50),
    Bonus("terms_values_count", ("terms_values",), 50, 0.10, 0.50),
)
_FORMULAS = (
    Formula(("_search", "_msearch", "_count", "_scroll", "_explain", "_validate"),
            {"took": 0.50, "shards": 0.15, "hits": 0.35}),
    Formula(("_bulk",), {"took": 0.45, "bulk_doc_count": 0.55}),
    Formula(("_update_by_query", "_delete_by_query"), {"took": 0.40, "docs_affected": 0.35, "shards": 0.25}),
    Formula(("_update",), {"took": 0.60, "shards": 0.40}),
)
_OTHER_WEIGHTS = {"took": 0.70, "shards": 0.30}


@dataclass(frozen=True)
class ScoringModel:
    """Everything that can be re-weighted.  Operations without a formula use ``other_weights``."""

    baselines: Baselines = field(default_factory=Baselines)
    indicators: tuple[Indicator, ...] = _INDICATORS
    bonuses: tuple[Bonus, ...] = _BONUSES
    formulas: tuple[Formula, ...] = _FORMULAS
    other_weights: dict[str, float] = field(default_factory=lambda: dict(_OTHER_WEIGHTS))
    unadjusted: tuple[str, ...] = ("_bulk", "_create", "index", "delete")

    def with_thresholds(self, **limits: int) -> "ScoringModel":
        """The model with other thresholds, by indicator name or bonus key."""
        known = {i.name for i in self.indicators} | {b.key for b in self.bonuses}
        unknown = set(limits) - known
        if unknown:
            raise ValueError(f"no such indicator or bonus: {sorted(unknown)}")
        return replace(
            self,
            indicators=tuple(replace(i, threshold=limits.get(i.name, i.threshold)) for i in self.indicators),
            bonuses=tuple(replace(b, threshold=limits.get(b.key, b.threshold)) for b in self.bonuses),
        )


DEFAULT_MODEL = ScoringModel()


def _count_column(name: str) -> Column:
    if name == "hits_lower_bound":
        return F.col("hits_lower_bound").cast("int")
    if name == "geo_vertex":
        return F.col("request_geo_vertex_count")
    return F.col(f"clause_counts_{name}")


def _total(counts: tuple[str, ...]) -> Column:
    return reduce(add, [_count_column(name) for name in counts])


def normalise(value: Column, baseline: Column) -> Column:
    return F.when(baseline != 0, value / baseline).otherwise(F.lit(0.0))


@built_once
def _indicator_columns(model: ScoringModel) -> tuple[dict[str, Column], dict[str, Column]]:
    queries = F.col("request_operation").isin(*QUERY_OPERATIONS)
    flags = {
        f"cost_indicators_{i.name}": (queries & (_total(i.counts) >= i.threshold)).cast("int")
        for i in model.indicators
    }
    fired = {i.name: F.col(f"cost_indicators_{i.name}") == 1 for i in model.indicators}
    names = F.filter(
        F.array(*[F.when(fired[i.name], F.lit(i.name)) for i in model.indicators]), lambda n: n.isNotNull()
    )
    count = reduce(add, [F.col(f"cost_indicators_{i.name}") for i in model.indicators])
    product = F.lit(1.0)
    for i in model.indicators:
        product = product * F.when(fired[i.name], F.lit(i.multiplier)).otherwise(F.lit(1.0))
    multipliers = F.create_map(*[
        part for i in model.indicators for part in (F.lit(i.name), F.when(fired[i.name], F.lit(i.multiplier)))
    ])
    nothing = F.create_map().cast("map<string,double>")
    return flags, {
        "stress_cost_indicator_count": count,
        "stress_cost_indicator_names": F.when(count == 0, F.array(F.lit("unflagged"))).otherwise(names),
        "stress_cost_indicator_multipliers": F.when(count == 0, nothing).otherwise(
            F.map_filter(multipliers, lambda k, v: v.isNotNull())
        ),
        "stress_multiplier": product,
    }


def with_cost_indicators(df: DataFrame, model: ScoringModel) -> DataFrame:
    """0/1 column per indicator, then names, count, multipliers and their product."""
    flags, derived = _indicator_columns(model)
    return df.withColumns(flags).withColumns(derived)


def _weight(component: str, model: ScoringModel) -> Column:
    operation = F.col("request_operation")
    out = None
    for formula in model.formulas:
        weight = F.lit(formula.weights.get(component, 0.0))
        hit = operation.isin(*formula.operations)
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    other = F.lit(model.other_weights.get(component, 0.0))
    return other if out is None else out.otherwise(other)


@built_once
def _component_columns(model: ScoringModel, dynamic: tuple[str, ...]) -> tuple[dict[str, Column], ...]:
    def unit(name: str) -> Column:
        static = F.lit(getattr(model.baselines, name))
        return F.coalesce(F.col(f"baseline_{name}"), static) if name in dynamic else static

    parts = {
        f"__{name}": _weight(name, model) * normalise(F.col(measure), unit(baseline))
        for name, (measure, baseline) in _INPUTS.items()
    }
    adjusted = ~F.col("request_operation").isin(*model.unadjusted)
    queries = F.col("request_operation").isin(*QUERY_OPERATIONS)

    def bonus(b: Bonus) -> Column:
        n = _total(b.counts)
        return F.when(
            queries & adjusted & (n > b.threshold),
            F.least(F.lit(b.weight) * F.log(1 + n - F.lit(b.threshold)), F.lit(b.cap)),
        )

    parts["__bonuses"] = F.struct(*[bonus(b).alias(b.key) for b in model.bonuses])
    each = {b.key: F.col("__bonuses")[b.key] for b in model.bonuses}
    parts_total = {"__bonus": reduce(add, [F.coalesce(each[k], F.lit(0.0)) for k in each], F.lit(0.0))}
    base = reduce(add, [F.col(f"__{name}") for name in (*_INPUTS, "bonus")])
    score = base * F.when(adjusted, F.col("stress_multiplier")).otherwise(F.lit(1.0))
    bonuses = F.create_map(*[part for k in each for part in (F.lit(k), F.round(each[k], PRECISION))])
    nothing = F.create_map().cast("map<string,double>")
    out = {f"stress_components_{name}": F.round(F.col(f"__{name}"), PRECISION) for name in COMPONENTS}
    out["stress_base"] = F.round(base, PRECISION)
    out["stress_score"] = F.round(score, PRECISION)
    out["stress_bonuses"] = F.when(F.col("__bonus") == 0, nothing).otherwise(
        F.map_filter(bonuses, lambda k, v: v.isNotNull())
    )
    return parts, parts_total, out


_NO_DYNAMIC: tuple[str, ...] = ()
_DYNAMIC = ("took_ms", "shards_total")


def with_stress(df: DataFrame, model: ScoringModel) -> DataFrame:
    """Components, bonuses, base and score.

    ``baseline_*`` columns, where the frame has them and they are not NULL, replace static baselines.
    """
    dynamic = _DYNAMIC if f"baseline_{_DYNAMIC[0]}" in df.columns else _NO_DYNAMIC
    for columns in _component_columns(model, dynamic):
        df = df.withColumns(columns)
    return df.drop(*[c for c in df.columns if c.startswith("__")])
