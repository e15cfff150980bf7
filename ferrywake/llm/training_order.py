"""Token ids in training order: a keyed permutation gives every sequence a global slot.

Texts become token ids (byte-level BPE ranks from a file, or plain bytes) with an end mark, cut into
sequences of a fixed length. They are numbered without gaps in the order of the files and of the rows in each,
whatever the splits and tasks: a part of a file numbers its own sequences, and the counts of the parts (one
number each) give the offsets. A Feistel network on the smallest even number of bits that
holds all numbers, walked until it lands among them, permutes the numbers under a key: no sort by a
random key, no table of the order, and the slot of any number can be recomputed. Rows are exchanged once,
by shard; each shard is a run of fixed-stride records in slot order, so a reader can seek to any slot and
go on sequentially.

A record is, little-endian: doc_id int64, chunk int32, tokens int32, then `length` uint16 ids, those past
the tokens 0. A shard holds `per_shard` records, the last one fewer.

Defined results: a null or empty text is one sequence that holds the end mark alone; a null doc_id is
stored as the least int64 and read back as null; rows that repeat are sequences of their own; an empty
table gives no shard. The order depends on the key and the files alone, so that shards built again are the same
and reading can be resumed over them; rows that come from no file are written to one first.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, partitions, slices, stash, table, texts_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 512
PER_SHARD = 4096
#: Parts of files up to which their offsets are broadcast.
PARTS = 1_000_000
HEAD = np.dtype([("doc_id", "<i8"), ("chunk", "<i4"), ("tokens", "<i4")])
NO_ID = -(1 << 63)
ROUNDS = 6
EDGE = re.compile(r"\S(?=[ \n\t\r])")


def record(length: int) -> np.dtype:
    return np.dtype([*HEAD.descr, ("ids", "<u2", (length,))])


class Feistel:
    """A permutation of 0..n-1 under a key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        rng = np.random.Generator(np.random.Philox(key=key & ((1 << 64) - 1)))
        self.keys = rng.integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & low
        for k in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._mix(a, k), a) if back else (b, a ^ self._mix(b, k))
        return a << h | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


_encoders: dict = {}


def encoder(ranks: str | None):
    """Function from UTF-8 bytes to uint16 ids with the end mark. ranks: file of base64 pieces and their ids; None: bytes."""
    if ranks is None:
        return lambda b: np.append(np.frombuffer(b, np.uint8).astype(np.uint16), np.uint16(256))
    if ranks not in _encoders:
        import tiktoken

        with open(ranks, "rb") as f:
            pieces = {base64.b64decode(a): int(i) for a, i in (line.split() for line in f)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pieces, special_tokens={})
        end = len(pieces)
        assert end < 1 << 16, "ids must fit 16 bits"

        def encode(b: bytes) -> np.ndarray:
            # one call merges a whole run of letters in quadratic time; a text goes in parts that end where a piece ends anyway
            text = b.decode("utf-8", "replace")
            ids = [i for part in _parts(text) for i in own.encode_ordinary(part)]
            ids.append(end)
            return np.array(ids, np.uint16)

        _encoders[ranks] = encode
    return _encoders[ranks]


def _parts(text: str, size: int = 50_000):
    """A long text cut where white space follows something else: there a piece ends whatever stands around it. A run without
    such a place stays whole."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cuts = [m.start() + 1 for m in EDGE.finditer(text, at, end)]
            if cuts:
                end = cuts[-1]
            else:
                m = EDGE.search(text, end - 1)
                end = m.start() + 1 if m else len(text)
        yield text[at:end]
        at = end


def _in_files(docs: DataFrame) -> DataFrame:
    """(file, at, doc_id, text): with the file of each row and where the part of it that a task reads begins."""
    try:
        where = docs.metadataColumn("_metadata")
        return docs.select(where["file_path"].alias("file"), where["file_block_start"].alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    except AnalysisException:  # not read from files
        return _in_files(stash(only(docs, "doc_id", "text")))


def tokenised(docs: DataFrame, ranks: str | None, length: int) -> DataFrame:
    """(file, at, first, doc_id, n, ids): ids as bytes; first: sequences of this part of the file before this row."""

    def work(batches):
        encode, part, first = encoder(ranks), None, 0
        for b in slices(batches):
            ids = [encode(t) for t in texts_of(b.column(3))]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = np.empty(len(ids), np.int64)
            parts = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for i, (p, seqs) in enumerate(zip(parts, (-(-n // length)).tolist())):
                if p != part:
                    part, first = p, 0
                starts[i] = first
                first += seqs
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts), b.column(2), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["file", "at", "first", "doc_id", "n", "ids"])

    return _in_files(docs).mapInArrow(work, "file string, at long, first long, doc_id long, n long, ids binary")


def shards(docs: DataFrame, key: int = 1, ranks: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(shard, first_slot, n, crc32, payload): fixed-stride records of all sequences in training order."""
    spark = docs.sparkSession
    tokens = stash(tokenised(docs, ranks, length))
    seqs = F.ceil(F.col("n") / length).cast("long")
    counts = tokens.groupBy("file", "at").agg(F.sum(seqs)).orderBy("file", "at").collect()  # one number for each part of a file
    base = np.append(0, np.cumsum([n for _, _, n in counts])).astype(np.int64)
    total = int(base[-1])
    order, kind = Feistel(max(total, 1), key), record(length)
    sent = None
    if len(counts) <= PARTS:  # a number and a name for each part
        sent = spark.sparkContext.broadcast({(f, a): int(x) for (f, a, _), x in zip(counts, base)})
        placed = tokens.select("first", "doc_id", "n", "ids", "file", "at")
    else:
        starts = spark.createDataFrame([(f, a, int(x)) for (f, a, _), x in zip(counts, base)], "file string, at long, base long")
        placed = tokens.join(starts, ["file", "at"]).select((F.col("base") + F.col("first")).alias("first"), "doc_id", "n", "ids")

    def records(batches):
        for b in slices(batches):
            first, docs_, n = (b.column(i) for i in range(3))
            first, n = first.to_numpy(), n.to_numpy()
            if sent is not None:
                first = first + np.fromiter(map(sent.value.__getitem__, zip(b.column(4).to_pylist(), b.column(5).to_pylist())), np.int64, len(first))
            ids = [np.frombuffer(x, "<u2") for x in b.column(3).to_pylist()]
            docs_ = docs_.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), 256):  # a few rows at a time
                m = -(-n[i : i + 256] // length)
                rows = np.zeros(int(m.sum()), kind)
                chunk = np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m)
                rows["doc_id"], rows["chunk"] = np.repeat(docs_[i : i + 256], m), chunk
                rows["tokens"] = np.minimum(np.repeat(n[i : i + 256], m) - chunk * length, length)
                flat = rows["ids"]
                at = 0
                for x, k in zip(ids[i : i + 256], m.tolist()):
                    padded = np.zeros(k * length, np.uint16)
                    padded[: len(x)] = x
                    flat[at : at + k] = padded.reshape(k, length)
                    at += k
                slot = order.slot(np.repeat(first[i : i + 256], m) + chunk)
                by = rows.view(np.dtype((np.void, kind.itemsize)))
                yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array([x.tobytes() for x in by], pa.binary())], ["shard", "slot", "record"])

    rows = placed.mapInArrow(records, "shard int, slot long, record binary")
    n_shards = -(-total // per_shard)
    spread = rows.repartition(max(1, min(n_shards, 8 * partitions(spark))), "shard")

    def joined(batches):
        held, now = [], None

        def out():
            payload = b"".join(held)
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((now, pa.int32()), (now * per_shard, pa.int64()), (n, pa.int64()), (zlib.crc32(payload), pa.int64()), (payload, pa.binary()))], ["shard", "first_slot", "n", "crc32", "payload"])

        for b in batches:
            for s, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if s != now and held:
                    yield out()
                    held = []
                now = s
                held.append(r)
        if held:
            yield out()

    return spread.sortWithinPartitions("shard", "slot").mapInArrow(joined, "shard int, first_slot long, n long, crc32 long, payload binary")


def manifest(blobs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each record of the shards: where it is, whose it is, and the CRC of its ids."""
    kind = record(length)

    def work(batches):
        for b in batches:
            for shard, first, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                x = np.frombuffer(payload, kind)
                doc = pa.array(x["doc_id"].copy(), mask=x["doc_id"] == NO_ID)
                crc = [zlib.crc32(r["ids"][: r["tokens"]].tobytes()) for r in x]
                at = np.arange(len(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + at), pa.array(np.full(len(x), shard, np.int32)), pa.array(at * kind.itemsize), doc, pa.array(x["chunk"].copy()), pa.array(x["tokens"].copy()), pa.array(crc, pa.int64())],
                    ["slot", "shard", "offset", "doc_id", "chunk", "n_tokens", "ids_crc32"],
                )

    return blobs.mapInArrow(work, "slot long, shard int, offset long, doc_id long, chunk int, n_tokens int, ids_crc32 long")


def export(blobs: DataFrame, uri: str) -> DataFrame:
    """Writes each shard to <uri>/shard-NNNNNN.bin, by way of a name that is moved into place when complete; returns (shard, path)."""

    def work(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(uri)
        where.create_dir(base, recursive=True)
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                path = f"{base}/shard-{shard:06d}.bin"
                part = f"{path}.{TaskContext.get().taskAttemptId()}"
                with where.open_output_stream(part) as f:
                    f.write(payload)
                where.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path])], ["shard", "path"])

    return blobs.mapInArrow(work, "shard int, path string")


def read_from(folder: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD):
    """Records from a slot on, in training order, out of exported shards; resumes anywhere by seeking."""
    kind = record(length)
    shard, skip = divmod(slot, per_shard)
    while os.path.exists(path := f"{folder}/shard-{shard:06d}.bin"):
        with open(path, "rb") as f:
            f.seek(skip * kind.itemsize)
            while chunk := f.read(kind.itemsize * 64):
                yield from np.frombuffer(chunk, kind)
        shard, skip = shard + 1, 0


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(stash(shards(table(spark, sf_dir, "documents"), key=20260101, ranks=RANKS)))
