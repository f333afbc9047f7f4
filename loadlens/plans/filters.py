"""Dashboard filters as one predicate."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Variable -> record column.
DIMENSIONS = {
    "cluster": "cluster_name",
    "application": "identity_applicative_provider",
    "target": "request_target",
    "operation": "request_operation",
    "username": "identity_username",
    "cost_indicator": "stress_cost_indicator_names",
    "client_host": "identity_client_host",
    "template": "request_template",
}
SUMMARY_DIMENSIONS = ("cluster", "application", "target", "operation", "template")


@dataclass(frozen=True)
class Filters:
    """Time range, values per dimension (absent = all), labels, and an extra SQL predicate."""

    start: datetime | None = None
    end: datetime | None = None
    dims: dict[str, list] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    extra: str = ""

    def __post_init__(self):
        unknown = set(self.dims) - set(DIMENSIONS)
        if unknown:
            raise ValueError(f"no such dimension: {sorted(unknown)}")

    def drill(self, dim: str, value) -> "Filters":
        """Narrow to one clicked value."""
        return replace(self, dims={**self.dims, dim: [value]})

    def needs_raw(self) -> bool:
        """Whether some filter is on a column the summary does not have."""
        return bool(self.labels or self.extra or set(self.dims) - set(SUMMARY_DIMENSIONS))

    def predicates(self, columns: list[str], time_col: str) -> list[Column]:
        out = []
        # Spark does not derive partition columns from a time range: name them, so that days and months are pruned.
        if self.start is not None:
            out.append(F.col(time_col) >= F.lit(self.start).cast("timestamp_ntz"))
            if "day" in columns:
                out.append(F.col("day") >= F.lit(self.start.date()))
            if "month" in columns:
                out.append(F.col("month") >= F.lit(self.start.date().replace(day=1)))
        if self.end is not None:
            out.append(F.col(time_col) < F.lit(self.end).cast("timestamp_ntz"))
            if "day" in columns:
                out.append(F.col("day") <= F.lit(self.end.date()))
            if "month" in columns:
                out.append(F.col("month") <= F.lit(self.end.date().replace(day=1)))
        for dim, values in self.dims.items():
            column = F.col(DIMENSIONS[dim])
            if dim == "cost_indicator":
                out.append(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])))
            else:
                out.append(column.isin(list(values)))
        for label, value in self.labels.items():
            out.append(F.try_element_at(F.col("identity_labels"), F.lit(label)) == value)
        if self.extra:
            out.append(F.expr(self.extra))
        return out

    def apply(self, df: DataFrame, time_col: str = "timestamp") -> DataFrame:
        for predicate in self.predicates(df.columns, time_col):
            df = df.where(predicate)
        return df
