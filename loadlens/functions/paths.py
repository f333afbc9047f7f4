"""What the request touches: operation and target from method and path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def _by_method(method: Column) -> Column:
    """Document operation by method; a method not named here writes."""
    out = F.when(method.isin("GET", "HEAD"), F.lit("get")).when(method == "DELETE", F.lit("delete"))
    return out.otherwise(F.lit("index"))


def target(path: Column) -> Column:
    """First path segment that is not an API name."""
    named = F.regexp_extract(path, r"(?:^|/)([^/_][^/]*)", 1)
    return F.when(named == "", F.lit("_all")).otherwise(named)


def operation(method: Column, path: Column) -> Column:
    """Last path segment that is an API name; documents are told apart by method."""
    api = F.regexp_extract(path, r"^(?:.*/)?(_[^/]*)", 1)
    return F.when((api == "") | (api == "_doc"), _by_method(method)).otherwise(api)
