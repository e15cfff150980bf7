"""Bytes of metric captures, built as the format says."""

import struct
import zlib


def document(fields: list[tuple[str, str, object]]) -> bytes:
    """fields: (type, name, value) with types i32 i64 f64 bool ts date str doc arr bin."""
    out = b""
    for kind, name, v in fields:
        code, body = {
            "i32": lambda v: (16, struct.pack("<i", v)),
            "i64": lambda v: (18, struct.pack("<q", v)),
            "f64": lambda v: (1, struct.pack("<d", v)),
            "bool": lambda v: (8, bytes([v])),
            "date": lambda v: (9, struct.pack("<q", v)),
            "ts": lambda v: (17, struct.pack("<II", v[1], v[0])),
            "str": lambda v: (2, struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0"),
            "doc": lambda v: (3, document(v)),
            "arr": lambda v: (4, document([(k, str(i), x) for i, (k, x) in enumerate(v)])),
            "bin": lambda v: (5, struct.pack("<i", len(v)) + b"\0" + v),
        }[kind](v)
        out += bytes([code]) + name.encode() + b"\0" + body
    return struct.pack("<i", len(out) + 5) + out + b"\0"


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def payload(baseline: bytes, columns: list[list[int]], attributes: int | None = None, tail: bytes = b"") -> bytes:
    """columns: the values of each attribute, in order."""
    deltas = [(b - a) & ((1 << 64) - 1) for c in columns for a, b in zip(c, c[1:])]
    stream, i = b"", 0
    while i < len(deltas):
        if deltas[i]:
            stream += varint(deltas[i])
            i += 1
            continue
        j = i
        while j < len(deltas) and not deltas[j]:
            j += 1
        stream += varint(0) + varint(j - i - 1)
        i = j
    n = len(columns) if attributes is None else attributes
    return baseline + struct.pack("<ii", n, len(columns[0]) - 1) + stream + tail


def block(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + zlib.compress(data)


def simple(times: list[int], **metrics: list[int]) -> bytes:
    """A metric document of start times and plain metrics by name (__ for /)."""
    fields = [("date", "start", times[0])] + [("i64", n, v[0]) for n, v in metrics.items()]
    return document([("i32", "type", 1), ("bin", "data", block(payload(document(fields), [times, *metrics.values()])))])


META = document([("i32", "type", 0), ("str", "doc", "metadata")])
