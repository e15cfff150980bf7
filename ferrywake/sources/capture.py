"""Binary metric captures: a file of length-prefixed documents, whose metric blocks hold compressed columns.

file := document*; document {type, data}; type 1 holds data := int32 length, zlib(payload);
payload := a baseline document, int32 attributes, int32 deltas, then for each attribute its deltas as
unsigned varints, a zero followed by how many more zeros, runs going on across attributes.

blocks_of() and samples_of() decode files in parallel, a file a task as one must be read from its start;
samples can be limited to paths, which are then the only columns that become rows.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the format.
LEAST_DOC, MOST_DOC = 5, 16 * 1024 * 1024
MOST_PAYLOAD, MOST_SAMPLES, MOST_CELLS = 10_000_000, 100_000, 1_000_000


class CaptureError(ValueError):
    """A capture that breaks the format; says where."""


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("utf-8", "replace"), end + 1


def _decimal128(raw: bytes) -> int:
    low, high = struct.unpack("<QQ", raw)
    if high >> 58 & 0x1F >= 0x1E:  # infinite or not a number
        return 0
    if high >> 61 & 3 == 3:
        return 0
    digits, power = (high & 0x1FFFFFFFFFFFF) << 64 | low, (high >> 49 & 0x3FFF) - 6176
    value = digits * 10**power if power >= 0 else digits // 10**-power
    value = -value if high >> 63 else value
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def _whole(x: float) -> int:
    if math.isnan(x):
        return 0
    return max(-(1 << 63), min((1 << 63) - 1, int(x))) if math.isfinite(x) else (1 << 63) - 1 if x > 0 else -(1 << 63)


def elements(data: bytes, start: int = 0):
    """(name, type, place, end) of the values of a document, whose length is checked."""
    if len(data) - start < LEAST_DOC:
        raise CaptureError("document cut short")
    size = struct.unpack_from("<i", data, start)[0]
    if size < LEAST_DOC or start + size > len(data) or data[start + size - 1]:
        raise CaptureError(f"bad document length {size}")
    at, end = start + 4, start + size - 1
    sizes = {1: 8, 6: 0, 7: 12, 8: 1, 9: 8, 10: 0, 16: 4, 17: 8, 18: 8, 19: 16, 127: 0, 255: 0}
    while at < end:
        kind = data[at]
        name, at = _cstring(data, at + 1)
        if kind in sizes:
            n = sizes[kind]
        elif kind in (2, 13, 14):
            n = 4 + struct.unpack_from("<i", data, at)[0]
        elif kind in (3, 4, 15):
            n = struct.unpack_from("<i", data, at)[0]
        elif kind == 5:
            n = 5 + struct.unpack_from("<i", data, at)[0]
        elif kind == 11:
            n = _cstring(data, _cstring(data, at)[1])[1] - at
        elif kind == 12:
            n = 4 + struct.unpack_from("<i", data, at)[0] + 12
        else:
            raise CaptureError(f"unknown type {kind} of {name}")
        if n < 0 or at + n > end:
            raise CaptureError(f"value of {name} runs over")
        yield name, kind, at, at + n
        at += n


def flatten(data: bytes, start: int = 0, prefix: str = "") -> tuple[list[str], list[int]]:
    """Paths and whole values of the numbers of a document, in its order."""
    paths: list[str] = []
    values: list[int] = []
    for name, kind, at, _ in elements(data, start):
        path = f"{prefix}/{name}" if prefix else name
        if kind in (3, 4):
            p, v = flatten(data, at, path)
            paths += p
            values += v
            continue
        if kind == 17:
            inc, sec = struct.unpack_from("<II", data, at)
            paths += [f"{path}/t", f"{path}/i"]
            values += [struct.unpack("<i", struct.pack("<I", x))[0] for x in (sec, inc)]
            continue
        value = {
            16: lambda: struct.unpack_from("<i", data, at)[0],
            18: lambda: struct.unpack_from("<q", data, at)[0],
            9: lambda: struct.unpack_from("<q", data, at)[0],
            1: lambda: _whole(struct.unpack_from("<d", data, at)[0]),
            8: lambda: int(data[at] != 0),
            19: lambda: _decimal128(data[at : at + 16]),
        }.get(kind)
        if value:
            paths.append(path)
            values.append(value())
    return paths, values


def varints(data: bytes, start: int) -> np.ndarray:
    """All unsigned varints from a place to the end, at once."""
    raw = np.frombuffer(data, np.uint8, offset=start)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = raw < 0x80
    if not last[-1]:
        raise CaptureError("varint cut short")
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts + 1
    if size.max() > 10 or (raw[ends[size == 10]] > 1).any():
        raise CaptureError("varint overflows")
    place = np.arange(len(raw)) - np.repeat(starts, size)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def inflate(data: bytes) -> bytes:
    if len(data) < 5:
        raise CaptureError("block cut short")
    size = struct.unpack_from("<I", data)[0]
    if not LEAST_DOC <= size <= MOST_PAYLOAD:
        raise CaptureError(f"declared length {size} out of bounds")
    z = zlib.decompressobj()
    try:
        out = z.decompress(data[4:], size + 1)
    except zlib.error as e:
        raise CaptureError(f"block does not inflate: {e}") from e
    if len(out) != size or not z.eof or z.unused_data:
        raise CaptureError("length of the inflated block differs, or bytes trail it")
    return out


def _runs(numbers: np.ndarray, total: int, first: int = 0) -> list[tuple[int, int, int]]:
    """What the numbers of a block stand for: (cell, number, count) of runs of values, and (cell, -1 - number behind, count)
    of runs of zeros. first: zeros that come before. Runs end where `total` cells are full."""
    out = [(0, -1, min(first, total))] if first else []
    stops = np.flatnonzero(numbers == 0)
    i, k, at = 0, 0, min(first, total)
    # a zero is followed by its run; a run that is itself 0 must not be taken for another zero
    while i < len(numbers) and at < total:
        k = int(np.searchsorted(stops, i))
        j = int(stops[k]) if k < len(stops) else len(numbers)
        n = min(j - i, total - at)
        if n:
            out.append((at, i, n))
        at, i = at + n, i + n
        if at == total or i == len(numbers):
            break
        if i + 1 >= len(numbers):
            raise CaptureError("varint cut short")
        run = int(numbers[i + 1]) + 1
        out.append((at, -3 - i, run))
        at, i = at + run, i + 2
    return [*out, (at, i, 0)]


def _cells(numbers: np.ndarray, total: int, first: int = 0) -> np.ndarray:
    cells = np.zeros(total, np.uint64)
    for at, number, n in _runs(numbers, total, first):
        if number >= 0:
            cells[at : at + n] = numbers[number : number + n]
    return cells


class Payload:
    """An inflated block: its paths, first values, and where each column's deltas begin."""

    def __init__(self, data: bytes):
        self.data = payload = inflate(data)
        if len(payload) < 13:
            raise CaptureError("payload cut short")
        size = struct.unpack_from("<i", payload)[0]
        if not LEAST_DOC <= size <= len(payload) - 8:
            raise CaptureError(f"bad baseline length {size}")
        n, deltas = struct.unpack_from("<ii", payload, size)
        if n < 1 or deltas < 0 or deltas + 1 > MOST_SAMPLES or n * (deltas + 1) > MOST_CELLS:
            raise CaptureError(f"{n} attributes by {deltas} deltas are out of bounds")
        self.paths, self.base = flatten(payload[:size])
        if len(self.paths) != n:
            raise CaptureError(f"{n} attributes declared, {len(self.paths)} found")
        if "start" not in self.paths:
            raise CaptureError("no start")
        self.n, self.deltas, self.at = n, deltas, size + 8

    def all(self) -> np.ndarray:
        """Values as attributes by points, every byte checked."""
        total = self.n * self.deltas
        numbers = varints(self.data, self.at)
        end, used, _ = _runs(numbers, total)[-1]
        if end > total:
            raise CaptureError("a run of zeros goes beyond the block")
        if end < total:
            raise CaptureError("deltas cut short")
        if used < len(numbers):
            raise CaptureError("bytes trail the deltas")
        return self._summed(np.array(self.base, np.int64), _cells(numbers, total).reshape(self.n, self.deltas))

    def index(self) -> tuple[list[int], list[int]]:
        """For each column, the byte where its first own number begins, and the zeros that a run leaves before it."""
        numbers = varints(self.data, self.at)
        raw = np.frombuffer(self.data, np.uint8, offset=self.at)
        begins = np.append(0, np.flatnonzero(raw < 0x80) + 1) + self.at
        offsets, zeros = [], []
        runs, k = _runs(numbers, self.n * self.deltas), 0
        for cell in range(0, self.n * self.deltas, self.deltas) if self.deltas else [0] * self.n:
            while k + 1 < len(runs) and runs[k + 1][0] <= cell:
                k += 1
            at, number, n = runs[k]
            ahead = number >= 0
            offsets.append(int(begins[number + cell - at if ahead else -1 - number]))
            zeros.append(0 if ahead else at + n - cell)
        return offsets, zeros

    def columns(self, which: list[int], offsets: list[int], zeros: list[int]) -> np.ndarray:
        """The values of some columns, by an index: no byte of another column is decoded."""
        cells = np.zeros((len(which), self.deltas), np.uint64)
        for i, c in enumerate(which):
            if zeros[c] < self.deltas:
                end = offsets[c + 1] if c + 1 < self.n else len(self.data)
                cells[i] = _cells(varints(self.data[:end], offsets[c]), self.deltas, zeros[c])
        return self._summed(np.array([self.base[c] for c in which], np.int64), cells)

    def _summed(self, base: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.concatenate([base.view(np.uint64)[:, None], cells], axis=1)
        return np.cumsum(out, axis=1, dtype=np.uint64).view(np.int64)


def decode_block(data: bytes) -> tuple[list[str], np.ndarray]:
    """Paths, and values as attributes by points."""
    p = Payload(data)
    return p.paths, p.all()


def scan(data: bytes):
    """(ordinal, offset, length, block bytes) of the metric blocks of a file."""
    at = ordinal = 0
    while at < len(data):
        if len(data) - at < 4:
            raise CaptureError(f"offset {at}: length cut short")
        size = struct.unpack_from("<i", data, at)[0]
        if not LEAST_DOC <= size <= MOST_DOC or at + size > len(data):
            raise CaptureError(f"offset {at}: bad document length {size}")
        kind, block = None, None
        for name, t, a, e in elements(data[at : at + size]):
            if name == "type":
                kind = {16: lambda: struct.unpack_from("<i", data, at + a)[0], 18: lambda: struct.unpack_from("<q", data, at + a)[0], 1: lambda: struct.unpack_from("<d", data, at + a)[0]}.get(t, lambda: None)()
            elif name == "data" and t == 5:
                block = data[at + a + 5 : at + e]
        if kind is None:
            raise CaptureError(f"offset {at}: no numeric type")
        if kind == 1:
            if block is None:
                raise CaptureError(f"offset {at}: no binary data")
            yield ordinal, at, size, block
            ordinal += 1
        at += size
    if not ordinal:
        raise CaptureError("no metric block")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def document(fields: list[tuple[int, str, bytes]]) -> bytes:
    body = b"".join(bytes([kind]) + name.encode() + b"\0" + value for kind, name, value in fields)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def encode_block(paths: list[str], values: np.ndarray) -> bytes:
    """A metric document of plain paths (`start` among them) and their values, attributes by points."""
    base = document([(9 if p == "start" else 18, p, struct.pack("<q", int(v))) for p, v in zip(paths, values[:, 0])])
    deltas = np.diff(values.astype(np.int64).view(np.uint64), axis=1).ravel()
    out, i = bytearray(), 0
    while i < len(deltas):
        if deltas[i]:
            out += _varint(int(deltas[i]))
            i += 1
            continue
        rest = np.flatnonzero(deltas[i:])
        run = int(rest[0]) if len(rest) else len(deltas) - i
        out += b"\0" + _varint(run - 1)
        i += run
    payload = base + struct.pack("<ii", len(paths), values.shape[1] - 1) + bytes(out)
    data = struct.pack("<I", len(payload)) + zlib.compress(payload)
    return document([(16, "type", struct.pack("<i", 1)), (5, "data", struct.pack("<i", len(data)) + b"\0" + data)])


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        raise ValueError("no file given")
    parts = [spark.read.format("binaryFile").load(p).select(F.lit(i).alias("file_id"), "content") for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _decoded(data: bytes):
    for ordinal, offset, size, block in scan(data):
        try:
            yield ordinal, offset, size, block, *decode_block(block)
        except CaptureError as e:
            raise CaptureError(f"offset {offset}, block {ordinal}: {e}") from e


BLOCKS = "file_id int, block_ordinal int, file_offset long, doc_length int, declared_len int, compressed_len int, num_deltas int, start_ms long, end_ms long, paths array<string>, offsets array<int>, zeros array<int>, payload binary"
SAMPLES = "path string, file_id int, block_start long, block_ordinal int, point_idx int, ts_ms long, value long"


def blocks_of(files: DataFrame) -> DataFrame:
    """One row for each metric block of files (file_id, content), checked whole."""

    def work(batches):
        for b in batches:
            for file_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for ordinal, offset, size, block, names, values in _decoded(data):
                    start = values[names.index("start")]
                    row = (file_id, ordinal, offset, size, struct.unpack_from("<i", block)[0], len(block) - 4, values.shape[1] - 1, int(start[0]), int(start[-1]), names, *Payload(block).index(), block)
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

    return files.mapInArrow(work, BLOCKS)


def samples_of(files: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """The long frame of the samples of files (file_id, content), of all metrics or of those named."""
    wanted = None if metrics is None else frozenset(metrics)

    def work(batches):
        for b in batches:
            for file_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for ordinal, _, _, _, names, values in _decoded(data):
                    ts = values[names.index("start")]
                    n = len(ts)
                    for i, name in enumerate(names):
                        if wanted is not None and name not in wanted:
                            continue
                        cols = [np.full(n, file_id, np.int32), np.full(n, ts[0]), np.full(n, ordinal, np.int32), np.arange(n, dtype=np.int32), ts, values[i]]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), *(pa.array(c) for c in cols)], [c.split()[0] for c in SAMPLES.split(", ")])

    return files.mapInArrow(work, SAMPLES)


def samples_of_blocks(blocks: DataFrame, metrics: list[str]) -> DataFrame:
    """The long frame of the named metrics alone, out of indexed blocks: blocks without any of them are not inflated, and
    of the others only the times and the named columns are decoded."""
    some = F.array(*[F.lit(m) for m in metrics])
    rows = blocks.where(F.arrays_overlap("paths", some)).select("file_id", "block_ordinal", "paths", "offsets", "zeros", "payload")

    def work(batches):
        for b in batches:
            for file_id, ordinal, names, offsets, zeros, block in zip(*(b.column(i).to_pylist() for i in range(6))):
                mine = [i for i, x in enumerate(names) if x in metrics]
                ts, *values = Payload(block).columns([names.index("start"), *mine], offsets, zeros)
                n = len(ts)
                for i, v in zip(mine, values):
                    cols = [np.full(n, file_id, np.int32), np.full(n, ts[0]), np.full(n, ordinal, np.int32), np.arange(n, dtype=np.int32), ts, v]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i]] * n), *(pa.array(c) for c in cols)], [c.split()[0] for c in SAMPLES.split(", ")])

    return rows.mapInArrow(work, SAMPLES)


def checked(blocks: DataFrame) -> DataFrame:
    """blocks (id, block) as (id, attributes, points, total, error): the shape and the sum of the values of a sound block, and
    what is wrong with any other, up to a colon."""

    def work(batches):
        for b in batches:
            out = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    _, values = decode_block(data)
                    out.append((i, *values.shape, int(values.sum()), None))
                except CaptureError as e:
                    out.append((i, None, None, None, str(e).split(":")[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "attributes", "points", "total", "error"])

    return blocks.mapInArrow(work, "id long, attributes long, points long, total long, error string")


def flattened(documents: DataFrame) -> DataFrame:
    """documents (id, document) as (id, position, path, value): their numbers in order."""

    def work(batches):
        for b in batches:
            out = [(i, k, p, v) for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (p, v) in enumerate(zip(*flatten(d)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["id", "position", "path", "value"])

    return documents.mapInArrow(work, "id long, position long, path string, value long")


def write_files(documents: DataFrame, folder: str) -> list[str]:
    """Writes documents (file_id, part, content) as one capture file for each file_id, its documents by part; returns the
    paths by file_id. A file is one task's, as it is when read."""

    def work(pdf):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        path = f"{base}/capture-{int(pdf['file_id'].iloc[0]):06d}.bin"
        with where.open_output_stream(path) as f:
            for content in pdf.sort_values("part")["content"]:
                f.write(content)
        return pdf[["file_id"]].head(1)

    ids = documents.groupBy("file_id").applyInPandas(work, "file_id int").collect()
    return [f"{folder}/capture-{r.file_id:06d}.bin" for r in sorted(ids)]


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    return blocks_of(_files(spark, paths))


def read_samples(spark: SparkSession, paths: list[str], metrics: list[str] | None = None) -> DataFrame:
    return samples_of(_files(spark, paths), metrics)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, sha256) of source files."""
    out = None
    for p in paths:
        one = spark.read.format("binaryFile").load(p).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.union(one)
    return out


def changed(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Stored files that are not there as they were."""
    return stored.join(now, ["path", "size", "sha256"], "left_anti")
