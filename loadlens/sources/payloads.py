"""Captured payloads: JSON files, JSON arrays, and the clean-up that makes them uniform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loadlens.functions.text import byte_text, decimal
from loadlens.schema import PAYLOAD

_IDENTITY_HEADERS = ("authorization", "x-opaque-id", "user-agent")
_CORRUPT = "_corrupt_record"

# What a scan reads: headers stay VARIANT until their shape is known.
SCAN = T.StructType(
    [T.StructField("headers", T.VariantType()) if f.name == "headers" else f for f in PAYLOAD.fields]
    + [T.StructField(_CORRUPT, T.StringType())]
)


def _checked_headers(headers: Column) -> dict[str, Column]:
    """Header map plus the reason why it cannot be used."""
    tags = F.try_variant_get(headers, "$", "map<string,string>")
    odd = F.lit(False)
    for name in _IDENTITY_HEADERS:
        value = F.try_variant_get(headers, f'$["{name}"]', "variant")
        odd = odd | (value.isNotNull() & (F.schema_of_variant(value) != "STRING"))
    problem = F.when(headers.isNotNull() & tags.isNull(), F.lit("headers are not an object")).when(
        odd, F.lit("identity header is not a string")
    )
    return {"headers": tags, "scan_error": problem}


def _finish_scan(df: DataFrame, byte_safe: bool) -> DataFrame:
    checked = _checked_headers(F.col("headers"))
    keep = [checked["headers"].alias("headers") if f.name == "headers" else F.col(f.name) for f in PAYLOAD.fields]
    return drop_unusable(df).select(
        *keep, checked["scan_error"].alias("scan_error"), F.lit(byte_safe).alias("byte_safe"))


def recover_text(df: DataFrame, bodies: bool) -> DataFrame:
    """Text of a byte-safe scan as UTF-8; bodies only if they are known not to be compressed.

    Frames from elsewhere (no ``byte_safe`` column) are text already.
    """
    if "byte_safe" not in df.columns:
        return df
    names = ["path", "client_host", "cluster_name", *(("request_body", "response_body") if bodies else ())]
    recovered = {n: F.when(F.col("byte_safe"), byte_text(F.col(n))).otherwise(F.col(n)) for n in names if n in df.columns}
    if "headers" in df.columns:
        decoded = F.transform_values("headers", lambda _, v: byte_text(v))
        recovered["headers"] = F.when(F.col("byte_safe"), decoded).otherwise(F.col("headers"))
    return df.withColumns(recovered)


def read_payloads(spark: SparkSession, path: str, byte_safe: bool = True, **options) -> DataFrame:
    """One JSON object per line.

    ``byte_safe`` reads each byte as one character, so that compressed bodies survive the scan.
    """
    return _finish_scan(_json_reader(spark.read, byte_safe, options).json(path), byte_safe)


def stream_payloads(spark: SparkSession, path: str, byte_safe: bool = True, **options) -> DataFrame:
    """The same over files as they arrive; ``maxFilesPerTrigger`` sets the batch size."""
    return _finish_scan(_json_reader(spark.readStream, byte_safe, options).json(path), byte_safe)


def _json_reader(reader, byte_safe: bool, options: dict):
    reader = reader.schema(SCAN).option("columnNameOfCorruptRecord", _CORRUPT)
    if byte_safe:
        reader = reader.option("encoding", "ISO-8859-1").option("lineSep", "\n")
    return reader.options(**options)


def drop_unusable(df: DataFrame) -> DataFrame:
    """Drop what is not JSON, or names no method or path."""
    usable = F.col("method").isNotNull() & F.col("path").isNotNull()
    if _CORRUPT in df.columns:
        usable = F.col(_CORRUPT).isNull() & usable
    return df.where(usable)


def explode_batches(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows that each hold a JSON array of payloads, one output row per slot.

    ``slot`` is the position in the array.  A slot that is not an object, or a row that is not an
    array, becomes a row with ``scan_error`` set; the other slots are not affected.
    """
    batch = F.try_parse_json(F.col(column))
    slots = F.try_variant_get(batch, "$", "array<variant>")
    failure = F.when(batch.isNull(), F.lit("unparseable payload")).when(
        slots.isNull(), F.lit("expected JSON array")
    )
    rest = [c for c in df.columns if c != column]
    parsed = df.select(*rest, failure.alias("__failure"), slots.alias("__slots"))
    # posexplode_outer keeps failed rows; an empty array has no payloads to report.
    parsed = parsed.where(F.col("__failure").isNotNull() | (F.size("__slots") > 0))
    opened = parsed.select(*rest, "__failure", F.posexplode_outer("__slots").alias("slot", "__slot"))
    item = F.col("__slot")
    is_object = F.startswith(F.to_json(item), F.lit("{"))
    fields = []
    for field in PAYLOAD.fields:
        kind = "variant" if field.name == "headers" else "string"
        fields.append(F.when(is_object, F.try_variant_get(item, f"$.{field.name}", kind)).alias(field.name))
    wide = opened.select(*rest, "slot", "__failure", is_object.alias("__object"), *fields)
    checked = _checked_headers(F.col("headers"))
    problem = F.coalesce(
        F.col("__failure"),
        F.when(~F.col("__object"), F.lit("non-object item")),
        checked["scan_error"],
    )
    keep = []
    for field in PAYLOAD.fields:
        value = checked["headers"] if field.name == "headers" else F.col(field.name)
        keep.append(value.try_cast(field.dataType).alias(field.name))
    return wide.select(*rest, "slot", *keep, problem.alias("scan_error"))


# Value of a missing field, by name; every other text is '' and every other number 0.
_MISSING = {"method": "GET", "path": "/", "cluster_name": "default"}


def clean_payload(df: DataFrame) -> DataFrame:
    """Payload with every field present, numbers checked, and ``scan_error`` for what cannot be used."""
    have = set(df.columns)

    def text(name: str) -> Column:
        default = F.lit(_MISSING.get(name, ""))
        return F.coalesce(F.col(name).cast("string"), default) if name in have else default

    def number(name: str) -> tuple[Column, Column]:
        raw = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        value = decimal(raw).try_cast("bigint")
        return F.coalesce(value, F.lit(0).cast("bigint")), raw.isNotNull() & value.isNull()

    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    event_time = F.coalesce(F.col("event_time").cast("timestamp_ntz"), now) if "event_time" in have else now
    status, bad_status = number("response_status")
    size, bad_size = number("response_size_bytes")
    scan_error = F.col("scan_error") if "scan_error" in have else F.lit(None).cast("string")
    headers = F.col("headers") if "headers" in have else F.lit(None)
    return df.select(
        event_time.alias("event_time"),
        text("method").alias("method"),
        text("path").alias("path"),
        F.coalesce(headers.cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("headers"),
        text("request_body").alias("request_body"),
        text("response_body").alias("response_body"),
        status.alias("response_status"),
        text("upstream_response_time").alias("upstream_response_time"),
        text("content_length").alias("content_length"),
        size.alias("response_size_bytes"),
        text("client_host").alias("client_host"),
        text("cluster_name").alias("cluster_name"),
        F.coalesce(
            scan_error,
            F.when(bad_status, F.lit("response_status is not a number")),
            F.when(bad_size, F.lit("response_size_bytes is not a number")),
        ).alias("scan_error"),
    )
