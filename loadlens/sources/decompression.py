"""Compressed bodies back to text.

Inflating is the one thing Spark SQL has no function for, so it is an Arrow UDF.  Which rows need it
is decided in the JVM: plain rows reach Python as NULL and cost one validity bit.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from loadlens.functions.text import byte_text

# The marker of base64-wrapped bodies, and the first bytes of gzip and zlib data
# seen as characters (a zlib header is 'x' plus a byte that makes it a multiple of 31).
WRAPPED_PREFIX = "gzip+b64:"
_MAGIC = r"^(?:\x1F\x8B|x[\x01\x20\x3F\x5E\x7D\x9C\xBB\xDA\xF9])"


def _inflater():
    """The UDF, made of inner functions: they travel to executors by value, which need not have this package."""

    def one(blob):
        """All gzip or zlib members of one blob; None when it is neither, or damaged."""
        parts = []
        try:
            while blob:
                stream = zlib.decompressobj(wbits=zlib.MAX_WBITS | 32)
                parts.append(stream.decompress(blob))
                if not stream.eof:
                    return None
                blob = stream.unused_data.lstrip(b"\0")
        except zlib.error:
            return None
        return b"".join(parts)

    def inflate(blobs: pd.Series) -> pd.Series:
        return blobs.map(one, na_action="ignore")

    return F.pandas_udf(inflate, T.BinaryType())


inflate = _inflater()


def decompress_bodies(df: DataFrame, columns=("request_body", "response_body")) -> DataFrame:
    """Inflate compressed text columns and recover UTF-8 in the others.

    Damaged wrapped bodies become ''; damaged unwrapped ones are kept as text.
    """
    for name in columns:
        text = F.col(name)
        wrapped = F.startswith(text, F.lit(WRAPPED_PREFIX))
        packed = F.regexp_replace(F.substr(text, F.lit(len(WRAPPED_PREFIX) + 1)), r"[^A-Za-z0-9+/=]", "")
        bare = text.rlike(_MAGIC) & ~text.rlike(r"[^\x00-\xFF]")
        blob = (
            F.when(wrapped, F.try_to_binary(packed, F.lit("base64")))
            .when(bare, F.encode(text, "ISO-8859-1"))
        )
        df = df.withColumn(f"__{name}", inflate(blob))
    restored = {}
    for name in columns:
        text, inflated = F.col(name), F.make_valid_utf8(F.col(f"__{name}").cast("string"))
        restored[name] = (
            F.when(F.startswith(text, F.lit(WRAPPED_PREFIX)), F.coalesce(inflated, F.lit("")))
            .otherwise(F.coalesce(inflated, byte_text(text)))
        )
    return df.withColumns(restored).drop(*[f"__{name}" for name in columns])
