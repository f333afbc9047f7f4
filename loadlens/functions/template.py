"""Literal-free request templates, built with one regular-expression pass over canonical JSON.

``canonical_json`` yields compact JSON with sorted keys.  In that form a scalar is either a string
that no ':' follows or a run of characters other than punctuation, so scrubbing is a scan that
alternates between "keys and brackets" and "one scalar", glued together with ``\\G``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SCALAR = rf'(?:{STRING}|[^{{}}\[\],:"]++)'
_SCRUB = rf'(?s)\G((?:{STRING}:|[{{}}\[\],])*+){SCALAR}'
_SPACE = rf'(?s)\G((?:[^",:]++|{STRING})*+)([,:])'

_BLANK = " \t\r\n"


def trimmed(text: Column) -> Column:
    """Text without JSON's blanks at its ends; trimming walks the whole text, so text that has none is passed on."""
    bare = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(_BLANK)))


def json_document(text: Column) -> Column:
    """Text as VARIANT, NULL unless it is exactly one JSON object.

    The text is parsed as the only element of an array, because the parser stops after the first
    value: rows of NDJSON or trailing garbage must not pass as a document.  Paths therefore start
    with ``$[0]``.
    """
    body = trimmed(text)
    is_object = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))
    parsed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(is_object, parsed)


def canonical_json(document: Column) -> Column:
    """Compact, key-sorted text of a ``json_document``."""
    text = F.to_json(document)
    return F.substr(text, F.lit(2), F.length(text) - 2)


def scrub(canonical: Column) -> Column:
    """Every scalar replaced by "?", keys and list lengths kept."""
    return F.regexp_replace(canonical, _SCRUB, '$1"?"')


def display_template(scrubbed: Column) -> Column:
    """Stored form of a template: ', ' and ': ' separators, ASCII only, '' for an empty body."""
    spaced = F.regexp_replace(scrubbed, _SPACE, "$1$2 ")
    return (
        F.when(scrubbed.isNull() | (scrubbed == "{}"), F.lit(""))
        .when(scrubbed.rlike(r"[^\x00-\x7F]"), _ascii(spaced))
        .otherwise(spaced)
    )


def _ascii(text: Column) -> Column:
    def escape(char: Column) -> Column:
        code = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return F.when(char.rlike(r"[^\x00-\x7F]"), F.regexp_replace(code, r"(.{4})", r"\\u$1")).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), escape), "")
