"""Shell-style documents of single-line logs: what regular expressions cannot balance.

Two small scanners, run over Arrow batches of the lines that need them and of no others.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constructors that stand for scalars.
_CALL = re.compile(r"(?:new\s+)?(?:Timestamp|BinData|UUID|ObjectId|NumberLong|NumberInt|ISODate|Date)\s*\(")
_KEY = re.compile(r"(\s*)([$A-Za-z0-9_.]+)(\s*:)")
_PART = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}()\[\],]|[^"{}()\[\],]+', re.S)


def _strings_apart(text: str, at: int = 0):
    """(start, end, token) of quoted strings, brackets, commas and what lies between."""
    for m in _PART.finditer(text, at):
        yield m.start(), m.end(), m[0]


def balanced(text: str, marker: str) -> str | None:
    """The braced document that follows the marker, or null if there is none or it does not end."""
    found = text.find(marker)
    start = text.find("{", found + len(marker)) if found >= 0 else -1
    if start < 0:
        return None
    depth = 0
    for _, end, token in _strings_apart(text, start):
        depth += (token == "{") - (token == "}")
        if not depth:
            return text[start:end]
    return None


def _call_end(text: str, start: int) -> int:
    depth = 0
    for _, end, token in _strings_apart(text, start):
        depth += (token == "(") - (token == ")")
        if not depth:
            return end
    return -1


def as_json(document: str) -> str:
    """Bare keys in quotes and constructors as "?", outside of strings."""
    out: list[str] = []
    at, key_may_follow = 0, False
    while at < len(document):
        m = _PART.match(document, at)
        token, end = m[0], m.end()
        if token[0] in '"{}()[],':
            out.append(token)
            key_may_follow = token in "{[,"
            at = end
            continue
        key = _KEY.match(token) if key_may_follow else None
        if key:
            out.append(f'{key[1]}"{key[2]}"{key[3]}')
            at += key.end()
            key_may_follow = False
            continue
        call = _CALL.search(document, at, end + 1)
        if call and (stop := _call_end(document, call.end() - 1)) >= 0:
            out += [document[at : call.start()], '"?"']
            at = stop
        else:
            out.append(token)
            at = end
        key_may_follow = False
    return "".join(out)


def _documents(message: pd.Series, operation: pd.Series) -> pd.DataFrame:
    def one(text, op, marker):
        found = balanced(text, marker(op)) if isinstance(text, str) and isinstance(op, str) else None
        return None if found is None else as_json(found)

    def marker(op):
        return "command:" if op in ("update", "remove") else f"command: {op}"

    return pd.DataFrame(
        {
            "command": [one(t, o, marker) for t, o in zip(message, operation)],
            "origin": [one(t, o, lambda _: "originatingCommand:") if o == "getMore" else None for t, o in zip(message, operation)],
        }
    )


def documents(message: Column, operation: Column) -> Column:
    """The command document of a message and the one it continues, as JSON."""
    return F.pandas_udf(_documents, "command string, origin string")(message, operation)


def balanced_after(text: Column, marker: str) -> Column:
    """The braced document after the marker, or null."""
    return F.pandas_udf(lambda xs: xs.map(lambda x: balanced(x, marker) if isinstance(x, str) else None), "string")(text)


def shell_as_json(document: Column) -> Column:
    return F.pandas_udf(lambda xs: xs.map(lambda x: as_json(x) if isinstance(x, str) else None), "string")(document)
