"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns by which diagnostic text is redacted, in this order, and what replaces each.
_QUOTED = r""""(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'"""
_VALUE = rf"(?:\[REDACTED\]|{_QUOTED}|[^\s,;\]}}]+)"
REDACTIONS = (
    (rf"(?i)((?:password|passwd|token|secret)[\"']?\s*[:=]\s*){_VALUE}", "$1[REDACTED]"),
    (rf"(?i)(\b(?:user(?:name)?|principal)\b[\"']?\s*[:=]\s*){_VALUE}", "$1[REDACTED]"),
    (rf"(?i)(\b(?:user(?:name)?|principal)\s+)(?:{_QUOTED})", "$1[REDACTED]"),
    (r"(?i)mongodb(?:\+srv)?://\S+", "[MongoDB URI]"),
    (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{0,4}:){2,}[0-9a-f:.]{0,15}(?:%[a-z0-9_.-]+)?(?![0-9a-f:])", "[IP]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
)

#: One step over a compact document: what surrounds scalars, then a scalar.
_SCALAR = r"""\G((?:[{}\[\],]|"(?:[^"\\]|\\.)*+":)*+)("(?:[^"\\]|\\.)*+"|[^\s{}\[\],":]+)"""
# The extended notation of typed scalars, by their only key and by pairs of keys.
_TYPED = r"oid|numberLong|numberInt|numberDouble|numberDecimal|date|uuid|undefined|symbol|minKey|maxKey|code"
_TYPED_DOCS = (
    rf'\{{"\$(?:{_TYPED})":"\?"\}}',
    r'\{"\$timestamp":\{"i":"\?","t":"\?"\}\}',
    r'\{"\$binary":(?:"\?","\$type":"\?"|\{"base64":"\?","subType":"\?"\})\}',
    r'\{"\$regularExpression":\{"options":"\?","pattern":"\?"\}\}',
    r'\{"\$options":"\?","\$regex":"\?"\}',
)


def trimmed(x: Column) -> Column:
    """Without control characters and spaces (all up to U+0020) at either end."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def without_bom(x: Column) -> Column:
    return F.regexp_replace(x, "^﻿", "")


def or_unknown(x: Column) -> Column:
    """The value, or `unknown` where it is null or blank."""
    return F.when(x.isNull() | (F.trim(F.regexp_replace(x, r"\s+", " ")) == ""), "unknown").otherwise(x)


def non_blank(*xs: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.regexp_replace(x, r"\s+", "") != "", x) for x in xs])


def redacted(x: Column) -> Column:
    """Diagnostic text without secrets, identities, addresses; null gives the empty string."""
    x = F.coalesce(x, F.lit(""))
    for pattern, to in REDACTIONS:
        x = F.regexp_replace(x, pattern, to)
    return x


def query_shape(document: Column) -> Column:
    """A query document with sorted keys and every scalar as "?"; null gives {}. The document is JSON text."""
    shape = F.regexp_replace(F.to_json(F.try_parse_json(document)), _SCALAR, '$1"?"')
    for _ in range(2):  # a typed scalar may hold another
        for typed in _TYPED_DOCS:
            shape = F.regexp_replace(shape, typed, '"?"')
    return F.when(document.isNull() | (document == "null"), "{}").otherwise(shape)


def host_of(address: Column) -> Column:
    """The host of [v6]:port, host:port, or a bare address."""
    bracket = F.regexp_extract(address, r"^\[([^\]]+)\]", 1)
    return (
        F.when(address.isNull() | (F.trim(address) == ""), F.lit(None))
        .when(address.startswith("["), F.when(bracket != "", bracket).otherwise(address))
        .when(address.rlike(r"^[^:]+:\d+$"), F.regexp_extract(address, r"^([^:]+):\d+$", 1))
        .otherwise(address)
    )


def contains_text(x: Column, text: str | None) -> Column:
    """Case-blind search for a trimmed text; a blank text matches all rows, and a null value none but that."""
    text = (text or "").strip().lower()
    return F.contains(F.lower(x), F.lit(text)) if text else F.lit(True)
