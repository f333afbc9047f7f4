"""Who sent the request: columns over the header map (lower-case keys)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the wire format.
BASIC_PREFIX = "Basic "
LABEL_PREFIX = "x-alo-"


def header(headers: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))


def username(headers: Column) -> Column:
    """User part of HTTP basic credentials, '' when absent or undecodable."""
    auth = header(headers, "authorization")
    # Lenient base64: bytes outside the alphabet are skipped, data ends at the padding.
    packed = F.regexp_replace(F.substr(auth, F.lit(len(BASIC_PREFIX) + 1)), r"[^A-Za-z0-9+/=]", "")
    decoded = F.make_valid_utf8(F.try_to_binary(packed, F.lit("base64")).cast("string"))
    name = F.split_part(decoded, F.lit(":"), F.lit(1))
    return F.when(F.startswith(auth, F.lit(BASIC_PREFIX)), F.coalesce(name, F.lit(""))).otherwise(F.lit(""))


def applicative_provider(headers: Column) -> Column:
    """The calling application: opaque id up to '/', else app name, else the agent's product token."""
    opaque, app, agent = (header(headers, n) for n in ("x-opaque-id", "x-app-name", "user-agent"))
    return (
        F.when(opaque != "", F.split_part(opaque, F.lit("/"), F.lit(1)))
        .when(app != "", app)
        .otherwise(F.regexp_extract(agent, r"^[^/ ]*", 0))
    )


def user_agent(headers: Column) -> Column:
    return header(headers, "user-agent")


def labels(headers: Column, prefix: str = LABEL_PREFIX) -> Column:
    """Custom labels: headers under the label prefix, prefix removed."""
    kept = F.map_filter(headers, lambda k, v: F.startswith(k, F.lit(prefix)) & (F.length(k) > len(prefix)))
    bare = F.transform_keys(kept, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))
    return F.coalesce(bare, F.create_map().cast("map<string,string>"))
