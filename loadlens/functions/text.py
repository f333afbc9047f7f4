"""Column builders over text: byte recovery, byte-exact truncation, lines, tolerant numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MAX_BODY_BYTES = 32_000
TRUNCATION_SUFFIX = "…[TRUNCATED]"
# Every line end that separates NDJSON rows.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"


def byte_text(text: Column) -> Column:
    """Text whose characters are bytes (U+0000..U+00FF) decoded as UTF-8; other text unchanged.

    Malformed bytes become U+FFFD.  Pure ASCII, the common case, is passed through untouched.
    """
    recovered = F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return (
        F.when(~text.rlike(r"[^\x00-\x7F]"), text)
        .when(text.rlike(r"[^\x00-\xFF]"), text)
        .otherwise(recovered)
    )


def lines(text: Column) -> Column:
    """Non-blank lines as an array, in order."""
    return F.filter(F.split(text, LINE_BREAK, -1), lambda line: line.rlike(r"\S"))


def is_truncated(text: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    return F.lit(False) if max_bytes <= 0 else F.octet_length(text) > max_bytes


def truncate_utf8(text: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    """Text cut to at most ``max_bytes`` bytes, suffix included, never inside a character."""
    if max_bytes <= 0:
        return text
    head = max(0, max_bytes - len(TRUNCATION_SUFFIX.encode("utf-8")))
    raw = F.encode(text, "UTF-8")

    def continues(position: int) -> Column:
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    # The cut may fall inside a character of up to four bytes: step back to where it starts.
    keep = F.lit(max(0, head - 3))
    for back in (2, 1, 0):
        if head - back >= 0:
            keep = F.when(~continues(head - back + 1), F.lit(head - back)).otherwise(keep)
    cut = F.substr(raw, F.lit(1), keep).cast("string")
    return F.when(is_truncated(text, max_bytes), F.concat(cut, F.lit(TRUNCATION_SUFFIX))).otherwise(text)


def decimal(text: Column) -> Column:
    """A number written as text, NULL for anything else; casts alone would take type suffixes ("1d")."""
    plain = F.when(text.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"), F.trim(text))
    return plain.try_cast("double")


def seconds_to_ms(text: Column) -> Column:
    """Seconds written as text, in milliseconds; anything else is 0."""
    return F.coalesce(decimal(text) * 1000, F.lit(0.0))


def whole_number(text: Column) -> Column:
    """An integer written as text; anything else, a decimal number too, is 0."""
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint")), F.lit(0).cast("bigint"))


def truncate_to_ms(ts: Column) -> Column:
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", -(micros % 1000), ts)
