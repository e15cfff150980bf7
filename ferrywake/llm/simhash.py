"""SimHash near-dedup by pigeonhole blocks.

Fingerprints of 64 bits are cut into blocks; two that differ in at most `bits` places agree on at least
`blocks - bits` of them, so they meet under one of the choices of that many blocks. Fingerprints are
joined on the chosen blocks (one shuffle of distinct fingerprints) and each meeting is verified by its
Hamming distance. A bucket of over `bucket` fingerprints is never held: its rows go to another round,
where the bits outside the key are cut into bits + 1 blocks once more, one of which must agree.

Defined results: a null or empty text, or one without words, has fingerprint 0, which links like any
other; fewer words than a shingle make one shingle; repeated shingles count each time; a bit set in
exactly half the hashes is 0; a null doc_id keeps its row and the component of its fingerprint (null if
no row of the component has an id). An empty table gives no rows. Extra columns are ignored.

The pipeline's stage (dissimilar) asks for more than 64 bits and a radius of 4 can tell: every pair of a Jaccard
similarity of 0.8 over five-word shingles. Their fingerprints are the same majorities, of 4096 bits: bits differ in a share
of at most 0.16 at 0.8 (0.19 where a set has under 8 shingles). Fingerprints are joined on blocks of 12 bits, each meeting
is verified by the Hamming distance in 128 further bits, and what is left by counting shingles. A pair at 0.8 agrees in one
of the 74 blocks (112 for sets under 16 shingles) and passes the distance with probability 0.9999 or more. Sets that are
equal are one class; classes that close fingerprints connect within a bucket are a group, whose classes are compared with
its middle one (the nearest to the majority of their bits). Groups that this leaves in several components are joined to one
for each component that most of them is of, and its pairs of different components are found by what they must share: ordered
with the shingles of the component's middle last, two similar sets have a shingle of their first fifths in common. A class
goes there with that fifth only, once for each part that its shingles are dealt to, never once for each block of others. The
pairs so found, of fingerprints not too far apart as a whole, are compared. The classes under a shingle that leaves more than
`hot` pairs a class, by size and place, are a group of the next round; groups still open after ROUNDS rounds are compared in
blocks, whole. A bucket of over `held` classes is one group, unheld. Texts without words are one class; sets too small to be
similar to a different one have no blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, only, partitions, runs, slices, stash, table, texts_of
from .graph import components, local_roots, with_least

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)
#: The contract's white space, \x20\x09-\x0D, is what bytes.split() splits on.
BUCKET = 4096
SMALL = 16
NO_ID = -(1 << 63)


def hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a text, as unsigned numbers."""
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    h = hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, thash, fp): a hash of the text, and the fingerprint as a signed long."""

    def of(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "thash", "fp"])

    rows = only(docs, "doc_id", "text").select("doc_id", text_hash().alias("thash"), "text")
    return rows.mapInArrow(of, "doc_id long, thash long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _cut(free: list[int], parts: int) -> list[int]:
    """Masks of as many blocks as asked for (or fewer, of one bit each) over the given bit places."""
    blocks = [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]
    return [sum(1 << x for x in b) for b in blocks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _links(fp: np.ndarray, bits: int) -> np.ndarray:
    """Index of the smallest fingerprint reachable within a bucket."""
    a, b = [], []
    for i in range(0, len(fp), 512):
        near = np.bitwise_count(fp[i : i + 512, None] ^ fp[None, :]) <= bits
        x, y = np.nonzero(near)
        x += i
        a.append(x[x > y])
        b.append(y[x > y])
    return local_roots(len(fp), np.concatenate(a), np.concatenate(b))


def _met(bits: int, bucket: int):
    """Over rows sorted by (mask, key): links within each bucket (mask null), and the rows of buckets too large to hold."""

    def work(batches):
        held: list[np.ndarray] = []
        large = None  # the key of the bucket whose rows are being passed on

        def pack(a, b, mask=None):
            n = len(a)
            m = pa.nulls(n, pa.int64()) if mask is None else pa.array(mask)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), m], ["a", "b", "mask"])

        def done(x):
            """x: whole buckets of at most `bucket` rows."""
            at = runs(x[0], x[1])
            size = np.diff(at)
            small = np.repeat(size <= SMALL, size)
            fa, fb = [], []
            for lag in range(1, min(SMALL, int(size.max(initial=0)))):
                same = small[lag:] & (x[0][lag:] == x[0][:-lag]) & (x[1][lag:] == x[1][:-lag])
                i = np.flatnonzero(same)
                i = i[np.bitwise_count((x[2][i] ^ x[2][i + lag]).view(np.uint64)) <= bits]
                fa.append(x[2][i])
                fb.append(x[2][i + lag])
            for k in np.flatnonzero(size > SMALL):
                fp = x[2][at[k] : at[k + 1]]
                root = _links(fp.view(np.uint64), bits)
                rest = root != np.arange(len(fp))
                fa.append(fp[rest])
                fb.append(fp[root[rest]])
            if fa:
                yield pack(np.concatenate(fa), np.concatenate(fb))

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if large is not None:
                mine = (x[0] == large[0]) & (x[1] == large[1])
                if mine.any():
                    yield pack(x[2][mine], x[2][mine], x[0][mine])
                    x = x[:, ~mine]
                if not x.shape[1]:
                    continue
                large = None
            if held:
                x = np.concatenate([held.pop(), x], axis=1)
            at = runs(x[0], x[1])
            last = at[-2]
            if last:
                big = np.repeat(np.diff(at) > bucket, np.diff(at))[:last]
                if big.any():
                    y = x[:, :last][:, big]
                    yield pack(y[2], y[2], y[0])
                yield from done(x[:, :last][:, ~big])
            rest = x[:, last:]
            if rest.shape[1] > bucket:
                large = (rest[0][0], rest[1][0])
                yield pack(rest[2], rest[2], rest[0])
            else:
                held.append(rest)
        if held:
            yield from done(held.pop())

    return work


def near_links(classes: DataFrame, bits: int = 4, blocks: int = 7, bucket: int = BUCKET) -> DataFrame:
    """classes: (fp) distinct longs. Links (a, b) whose components are those of all pairs within `bits`."""
    spark = classes.sparkSession
    parts = _cut(list(range(64)), blocks)
    masks = [sum(c) for c in combinations(parts, blocks - bits)]
    todo = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        keyed = todo.select("mask", F.expr("fp & mask").alias("key"), "fp")
        met = keyed.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_met(bits, bucket), "a long, b long, mask long")
        met = stash(met)
        now = met.where("mask is null").select("a", "b")
        found = now if found is None else found.union(now)
        rest = met.where("mask is not null").select(F.col("a").alias("fp"), "mask")
        wider = [r.mask for r in rest.select("mask").distinct().collect()]  # as many as there are masks, whatever the rows
        if not wider:
            return found
        cut = {}
        for m in wider:
            free = [i for i in range(64) if not (m % (1 << 64)) >> i & 1]
            cut[m] = [_signed((m % (1 << 64)) | x) for x in _cut(free, bits + 1)]
        step = F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*[F.lit(y) for y in x]) for m in cut.items() for x in m])
        todo = rest.select("fp", F.explode(step[F.col("mask")]).alias("mask"))


def near_components(docs: DataFrame, shingle: int = 4, bits: int = 4, blocks: int = 7, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, thash, fp, component_id) for each document."""
    fps = stash(fingerprints(docs, shingle))
    classes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    reach = components(near_links(classes.select("fp"), bits, blocks, bucket))
    member = classes.join(reach.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = with_least(stash(member)).select("fp", "component_id")
    return fps.join(named.hint("merge"), "fp").select("doc_id", "thash", "fp", "component_id")


#: Bytes of text whose words are hashed at once, unless one word is longer.
PIECE = 1 << 20
ODD = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the fingerprints of shingle sets; those that distances are taken of; those of a block; how many blocks are joined.
PLACES = 4096
SEEN = 128
KEY = 12
TABLES = 74
APART = 38
#: The same for sets of few shingles, whose majorities are less steady.
FEW = 16
FEW_TABLES = 112
FEW_APART = 46
#: Classes of a bucket held by a task.
HELD = 1 << 16
#: Members compared with their group's first in one task, and texts compared with each other at once (twice that many).
MEMBERS = 1024
BLOCK = 256
#: Characters of the texts whose first shingles are met in one task; pairs looked at for each class under a shingle.
PART = 1 << 18
HOT = 64
#: Most bits of the distance and of all blocks joined, SEEN + TABLES * KEY, in which sets at 0.8 differ: six deviations over the mean.
WORDS = 21
FAR = 233
FEW_FAR = 268
ROUNDS = 4


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(0, n - 1), base % (1 << 64), np.uint64)))


_tables: dict[str, np.ndarray] = {}


def _word_hashes(line: bytes) -> np.ndarray:
    """A polynomial hash of each word of a line of words with one space between."""
    if "byte" not in _tables:
        rng = np.random.Generator(np.random.Philox(key=42))
        _tables.update(byte=rng.integers(0, 1 << 63, 256, dtype=np.uint64), up=_powers(ODD, 2 * PIECE), down=_powers(pow(ODD, -1, 1 << 64), 2 * PIECE))
    out, at = [], 0
    while at < len(line):
        end = line.find(b" ", at + PIECE) if at + PIECE < len(line) else -1
        end = len(line) if end < 0 else end
        data = np.frombuffer(line, np.uint8, end - at, at)
        up, down = _tables["up"], _tables["down"]
        if len(data) >= len(up):  # one word of over PIECE bytes
            up, down = _powers(ODD, len(data) + 1), _powers(pow(ODD, -1, 1 << 64), len(data) + 1)
        sums = np.append(np.uint64(0), np.cumsum(_tables["byte"][data] * up[: len(data)]))
        gaps = np.flatnonzero(data == 32)
        start, stop = np.append(0, gaps + 1), np.append(gaps, len(data))
        out.append((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; fewer words than a shingle make one."""
    words = [t.translate(FOLD).split() for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = _word_hashes(b" ".join([w for ws in words for w in ws]))
    flat = (flat ^ (flat >> np.uint64(32))) * MIX
    at = np.append(0, np.cumsum(size))

    def rolled(x: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(x) - k + 1, np.uint64)
        for i in range(k):
            h = h * np.uint64(ODD) + x[i : i + len(h)]
        h = (h ^ (h >> np.uint64(32))) * MIX
        return h ^ (h >> np.uint64(29))

    full = rolled(flat, shingle) if len(flat) >= shingle else None
    out = []
    for n, a in zip(size.tolist(), at.tolist()):
        if n >= shingle:
            out.append(np.unique(full[a : a + n - shingle + 1]))
        else:
            out.append(rolled(flat[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def signs(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set of shingles: a bit is 1 if set in over half of its shingles.

    Bit j of a shingle is the parity of j & (its hash's low bits), not flipped if its top bit is 1: so the sums of all bits
    are a Walsh-Hadamard transform of the signed counts of the low bits."""
    if "walsh" not in _tables:
        n = np.arange(64)
        _tables["walsh"] = 1 - 2 * (np.bitwise_count(n[:, None] & n) % 2).astype(np.float32)
    walsh, out = _tables["walsh"], np.zeros((len(sets), PLACES), bool)
    for i in range(0, len(sets), 64):
        part = sets[i : i + 64]
        flat = np.concatenate(part)
        at = np.repeat(np.arange(len(part)) * PLACES, [len(x) for x in part]) + (flat & np.uint64(PLACES - 1)).astype(np.int64)
        sums = np.bincount(at, 1.0 - 2.0 * (flat >> np.uint64(63)), len(part) * PLACES).astype(np.float32)
        out[i : i + 64] = (walsh @ (sums.reshape(-1, 64) @ walsh).reshape(-1, 64, 64) > 0).reshape(-1, PLACES)
    return out


def marks(sets: list[np.ndarray], least: float) -> list[bytes | None]:
    """Of each fingerprint the bits that distances are taken of, and the bits of each block as a short; none for sets
    that cannot be similar to a different one."""
    if "drawn" not in _tables:
        _tables["drawn"] = np.random.Generator(np.random.Philox(key=42)).permutation(PLACES)
    drawn, bits = _tables["drawn"], signs(sets)
    seen = np.packbits(bits[:, drawn[:SEEN]], axis=1)
    blocks = bits[:, drawn[SEEN : SEEN + FEW_TABLES * KEY]].reshape(-1, FEW_TABLES, KEY) @ (1 << np.arange(KEY)).astype(np.int16)
    return [None if len(x) < least * (len(x) + 1) else s.tobytes() + b[: FEW_TABLES if len(x) < FEW else TABLES].tobytes() for x, s, b in zip(sets, seen, blocks)]


def shingled(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, thash, node, mark): a hash of the set of shingles, and what is joined of its fingerprint."""

    def of(batches):
        for b in slices(batches):
            sets = shingle_sets(texts_of(b.column(2)), shingle)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(marks(sets, least), pa.binary())], ["doc_id", "thash", "node", "mark"])

    texts = only(docs, "doc_id", "text").select("doc_id", text_hash().alias("thash"), "text")
    return texts.mapInArrow(of, "doc_id long, thash long, node long, mark binary")


def _blocks(batches):
    """From (node, mark) a row of (key, node, s, t, few) for each block: the block's number and bits, the bits for distances."""
    for b in slices(batches):
        node, mark = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        size = np.array([len(m) for m in mark])
        for n in np.unique(size):
            mine = np.flatnonzero(size == n)
            raw = np.frombuffer(b"".join([mark[i] for i in mine]), np.uint8).reshape(len(mine), n)
            tables = (n - SEEN // 8) // 2
            key = raw[:, SEEN // 8 :].copy().view(np.int16) + (np.arange(tables, dtype=np.int64) << KEY)
            seen = raw[:, : SEEN // 8].copy().view(np.int64)
            cols = [key.ravel(), *(np.repeat(x, tables) for x in (node[mine], seen[:, 0], seen[:, 1])), np.full(key.size, tables != TABLES)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "node", "s", "t", "few"])


def close_roots(seen: np.ndarray, few: np.ndarray) -> np.ndarray:
    """seen (2, n): an index for each of n fingerprints, equal for those connected by distances within APART (FEW_APART if one is of few shingles)."""
    limit = np.where(few, FEW_APART, APART).astype(np.uint8)

    def close(i, j):
        return np.bitwise_count(seen[0, i, None] ^ seen[0, j]) + np.bitwise_count(seen[1, i, None] ^ seen[1, j]) <= np.maximum(limit[i, None], limit[j])

    root, rest = np.arange(seen.shape[1]), np.arange(seen.shape[1])
    if len(rest) <= BLOCK:
        near = close(rest, rest)
        if np.count_nonzero(near) == len(rest):
            return root
        a, b = np.nonzero(near)
        return local_roots(len(rest), a, b)
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = np.array([first])
        while len(todo) and len(rest):
            met = close(todo[:BLOCK], rest).any(axis=0)
            todo = np.append(todo[BLOCK:], rest[met])
            root[rest[met]] = first
            rest = rest[~met]
    return root


def _group(node: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, node, to) of a group: its name, its nodes and the one nearest to the majority of their bits (2, n)."""
    if len(node) == 2:
        middle = 0
    else:
        bits = np.unpackbits(np.ascontiguousarray(seen.T).view(np.uint8), axis=1)
        middle = (bits != (bits.sum(axis=0, dtype=np.int64) * 2 > len(bits))).sum(axis=1).argmin()
    name = np.uint64(xxhash.xxh64_intdigest(node.tobytes())).view(np.int64)
    return np.full(len(node), name), node, np.full(len(node), node[middle])


def _packed(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["bucket", "node", "to"])


def _groups(most: int):
    """Over rows (key, node, s, t, few) sorted by key: (bucket, node, to) for each group of several connected nodes of a key,
    named by its nodes, with its middle one; a key of over `most` rows is one group, passed on unheld, of no middle."""

    def whole(x):
        name = np.full(x.shape[1], np.uint64(xxhash.xxh64_intdigest(x[0][:1].tobytes())).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(x[1]), pa.nulls(len(name), pa.int64())], ["bucket", "node", "to"])

    def done(x):
        at = runs(x[0])
        found = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if j - i > most:
                yield whole(x[:, i:j])
            elif j - i > 1:
                root = close_roots(x[2:4, i:j].view(np.uint64), x[4, i:j] != 0)
                if np.array_equal(root, np.arange(j - i)):
                    continue
                order = np.lexsort((x[1, i:j], root))
                ends = runs(root[order])
                for a, b in zip(ends[:-1], ends[1:]):
                    if b - a > 1:
                        found.append(_group(x[1, i:j][order[a:b]], x[2:4, i:j][:, order[a:b]]))
        if found:
            yield _packed(found)

    def work(batches):
        held: list[np.ndarray] = []
        large = None  # the key whose rows are being passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            if large is not None:
                mine = x[0] == large
                if mine.any():
                    yield whole(x[:, mine])
                    x = x[:, ~mine]
                if not x.shape[1]:
                    continue
                large = None
            if held:
                x = np.concatenate([held.pop(), x], axis=1)
            last = runs(x[0])[-2]
            yield from done(x[:, :last])
            rest = x[:, last:]
            if rest.shape[1] > most:
                large = rest[0][0]
                yield whole(rest)
            else:
                held.append(rest)
        if held:
            yield from done(held.pop())

    return work


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if not len(a):
        return True
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both >= least * (len(a) + len(b) - both)


def _with_first(shingle: int, least: float):
    """Over rows (to, chunk, role, node, text) in this order: (node, to) where a member (role 1) is like its group's first (role 0)."""

    def work(batches):
        first, at = np.zeros(0, np.uint64), None
        for b in slices(batches):
            to, chunk, role, node = (b.column(i).to_pylist() for i in range(4))
            out = []
            for t, c, r, n, x in zip(to, chunk, role, node, shingle_sets(texts_of(b.column(4)), shingle)):
                if r == 0:
                    first, at = x, (t, c)
                elif (t, c) == at and _alike(first, x, least):
                    out.append((n, t))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["node", "to"])

    return work


def heads(size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sets in one order of all shingles, how many of the first ones hold the first that it has in common with a similar
    set: with one not smaller, and with any."""
    return (size - np.ceil(2 * least / (1 + least) * size - 1e-6) + 1).astype(np.int64), (size - np.ceil(least * size - 1e-6) + 1).astype(np.int64)


HEAD = {"to": pa.int64(), "part": pa.int64(), "node": pa.int64(), "label": pa.int64(), "mark": pa.binary(), "size": pa.int64(), "head": pa.binary()}


def _heads(shingle: int, least: float):
    """Over rows (to, chunk, role, node, label, parts, mark, text) in this order: (to, part, node, label, mark, size, head), the
    first shingles of each member (role 1) with their places; the shingles of its group's middle (role 0) come last."""

    def work(batches):
        last, at = np.zeros(0, np.uint64), None
        for b in slices(batches):
            out = []
            for *row, x in zip(*(b.column(i).to_pylist() for i in range(7)), shingle_sets(texts_of(b.column(7)), shingle)):
                to, chunk, role, node, label, parts, mark = row
                if role == 0:
                    last, at = x, (to, chunk)
                elif (to, chunk) == at:
                    late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                    head = np.concatenate([x[~late], x[late]])[: heads(np.array(len(x)), least)[1]]
                    part = (head % np.uint64(parts)).astype(np.int64)
                    for k in np.unique(part).tolist():
                        mine = np.flatnonzero(part == k)
                        out.append((to, k, node, label, mark, len(x), head[mine].tobytes() + mine.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(HEAD.values())], list(HEAD))

    return work


def meetings(node: np.ndarray, label: np.ndarray, mark: np.ndarray, size: np.ndarray, head: list[bytes], least: float, hot: int) -> tuple[np.ndarray, list[tuple]]:
    """Pairs (2, n) of nodes of different labels that may be similar, by the first shingle that they have in common and by
    their fingerprints (mark: rows of WORDS longs); and the group of all nodes of each shingle that leaves over `hot` pairs a
    node to look at, not counting those within the most frequent label."""
    n = np.array([len(x) // 12 for x in head])
    owner = np.repeat(np.arange(len(n)), n)
    token = np.frombuffer(b"".join([x[: 8 * k] for x, k in zip(head, n.tolist())]), np.uint64)
    place = np.frombuffer(b"".join([x[8 * k :] for x, k in zip(head, n.tolist())]), np.int32).astype(np.int64)
    order = np.lexsort((node[owner], token))
    owner, token, place = owner[order], token[order], place[order]
    short = heads(size, least)[0]
    need = least / (1 + least)
    pairs, groups = [np.zeros((2, 0), np.int64)], []

    def keep(i, j):
        """Of pairs of places in the sorted shingles."""
        a, b = owner[i], owner[j]
        mine = label[a] != label[b]
        i, j, a, b = i[mine], j[mine], a[mine], b[mine]
        enough = np.minimum(size[a] - place[i], size[b] - place[j]) >= need * (size[a] + size[b]) - 1e-6
        near = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-6
        ahead = (size[a] <= size[b]) & (place[i] < short[a]) | (size[b] <= size[a]) & (place[j] < short[b])
        mine = enough & near & ahead
        a, b = a[mine], b[mine]
        apart = np.zeros(len(a), np.int64)
        for w in range(WORDS):
            apart += np.bitwise_count(mark[a, w] ^ mark[b, w])
        mine = apart <= np.where(np.minimum(size[a], size[b]) < FEW, FEW_FAR, FAR)
        x = np.stack([node[a[mine]], node[b[mine]]])
        pairs.append(np.stack([x.max(axis=0), x.min(axis=0)]))
        if len(pairs) > 1024:
            pairs[:] = [np.unique(np.concatenate(pairs, axis=1), axis=1)]

    at = runs(token)
    count = np.diff(at)
    few = np.repeat(count <= hot, count)
    for lag in range(1, int(count[count <= hot].max(initial=1))):
        i = np.flatnonzero(few[lag:] & (token[lag:] == token[:-lag]))
        keep(i, i + lag)
    for k in np.flatnonzero(count > hot).tolist():
        every = np.arange(at[k], at[k + 1])
        labels, which, many = np.unique(label[owner[every]], return_inverse=True, return_counts=True)
        order = np.argsort(size[owner[every]], kind="stable")
        by_size, lesser = every[order], which[order] != many.argmax()
        sizes = size[owner[by_size]]
        start = np.searchsorted(sizes, least * sizes - 1e-6)
        stop = np.searchsorted(sizes, (sizes - place[by_size]) / need - sizes + 1e-5, "right")  # larger ones have too little in common
        others = np.where(lesser, np.maximum(stop - start, 0), 0)
        if others.sum() > hot * len(every):
            groups.append(_group(node[owner[every]], mark[owner[every], :2].T))
            continue
        ends = np.cumsum(others)
        for low in range(0, int(ends[-1]), 1 << 20):
            nth = np.arange(low, min(low + (1 << 20), int(ends[-1])))
            i = np.searchsorted(ends, nth, "right")
            keep(by_size[i], by_size[start[i] + nth - (ends - others)[i]])
    return np.unique(np.concatenate(pairs, axis=1), axis=1), groups


def _meetings(least: float, hot: int):
    """Over rows as of _heads, sorted by to and part: (bucket, node, to), with no bucket for a pair to compare."""

    width = SEEN // 8 + 2 * TABLES

    def work(batches):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            mark = np.frombuffer(b"".join([x[: width].ljust(8 * WORDS, b"\0") for x in t.column("mark").to_pylist()]), np.uint64).reshape(-1, WORDS)
            pairs, groups = meetings(t.column("node").to_numpy(), t.column("label").to_numpy(), mark, t.column("size").to_numpy(), t.column("head").to_pylist(), least, hot)
            yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])], ["bucket", "node", "to"])
            if groups:
                yield _packed(groups)

        now = None
        for b in batches:
            if not b.num_rows:
                continue
            to, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = runs(to, part)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if (to[i], part[i]) != now:
                    if held:
                        yield from done()
                    held, now = [], (to[i], part[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from done()

    return work


def like_pairs(sets: list[np.ndarray], label: np.ndarray, half: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a Jaccard similarity of `least` or more, of different labels and different halves (negative halves meet all)."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at, owner = np.append(0, np.cumsum(size)), np.repeat(np.arange(n), size)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    out = []
    for i in range(n - 1):
        other = np.flatnonzero((np.arange(n) > i) & (label != label[i]) & ((half != half[i]) | (half < 0)))
        other = other[np.minimum(size[other], size[i]) >= least * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        mine = ids[at[i] : at[i + 1]]
        mark[mine] = True
        both = np.bincount(owner[at[i + 1] :][mark[ids[at[i + 1] :]]], minlength=n)[other]
        mark[mine] = False
        out += [(i, j) for j in other[both >= least * (size[i] + size[other] - both)].tolist()]
    return out


def _with_others(shingle: int, least: float):
    """Over rows (bucket, i, j, block, label, node, text) sorted by bucket, i and j: (node, to) for the alike of blocks i and j."""

    def work(batches):
        held: list[tuple] = []
        now = None

        def out():
            label = np.array([x[1] for x in held])
            half = np.array([-1 if now[1] == now[2] else x[0] for x in held])
            got = like_pairs([x[3] for x in held], label, half, least)
            return pa.RecordBatch.from_arrays([pa.array([held[p[k]][2] for p in got], pa.int64()) for k in (0, 1)], ["node", "to"])

        for b in slices(batches):
            bucket, i, j, block, label, node = (b.column(k).to_pylist() for k in range(6))
            for u, k, l, n, x in zip(zip(bucket, i, j), block, label, node, shingle_sets(texts_of(b.column(6)), shingle)):
                if u != now:
                    if len(held) > 1:
                        yield out()
                    held, now = [], u
                if not held or held[-1][2] != n:
                    held.append((k, l, n, x))
        if len(held) > 1:
            yield out()

    return work


def similar_links(docs: DataFrame, classes: DataFrame, shingle: int, least: float, most: int = MEMBERS, block: int = BLOCK, held: int = HELD, part: int = PART, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """classes (node, one, mark). Links (node, to) whose components are those of all pairs whose fingerprints meet and are close, and that are alike.

    Each class is compared with the middle of its group, in parts of `most`; where that leaves a group of several components,
    those of its other pairs of different components are compared that share one of their first shingles."""
    p = partitions(docs.sparkSession)
    joined = classes.where("mark IS NOT NULL").select("node", "mark").mapInArrow(_blocks, "key long, node long, s long, t long, few boolean")
    keyed = stash(joined.repartition(p, "key").sortWithinPartitions("key").mapInArrow(_groups(held), "bucket long, node long, to long").distinct())
    unheld = keyed.where("to IS NULL").groupBy("bucket").agg(F.min("node").alias("first"))
    groups = stash(keyed.join(unheld.hint("merge"), "bucket", "left").select("bucket", "node", F.coalesce("to", "first").alias("to")))
    none = F.lit(NO_ID)
    need = groups.select("node").distinct().join(classes.select("node", "one", "mark").hint("merge"), "node")
    texts = docs.select(text_hash().alias("th"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), "text")
    kept = stash(texts.join(need.select("node", "mark", F.col("one.thash").alias("th"), F.col("one.id").alias("id")).hint("merge"), ["th", "id"]).select("node", "mark", "text").dropDuplicates(["node"]))

    def with_first(members: DataFrame, sized: DataFrame, *more: str) -> DataFrame:
        """Members (node, to, ..) with their texts in parts of about `most`, the text of `to` before each part; sized (to, n, ..)."""
        sized = sized.withColumn("chunks", F.ceil(F.col("n") / most).cast("int"))
        rows = members.join(sized.hint("merge"), "to").withColumns({"chunk": F.pmod(F.xxhash64("node"), "chunks").cast("int"), "role": F.lit(1)}).join(kept.hint("merge"), "node")
        first = sized.join(kept.withColumnRenamed("node", "to").hint("merge"), "to").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "role": F.lit(0), "node": F.col("to"), "label": F.col("to")})
        columns = ["to", "chunk", "role", "node", *more, "text"]
        return first.select(columns).union(rows.select(columns)).repartition(p, "to", "chunk").sortWithinPartitions("to", "chunk", "role")

    def compared(star: DataFrame) -> DataFrame:
        star = stash(star.where("node <> to").select("node", "to").distinct())
        return stash(with_first(star, stash(star.groupBy("to").agg(F.count("*").alias("n")))).mapInArrow(_with_first(shingle, least), "node long, to long"))

    links = compared(groups)
    for left in reversed(range(rounds + 1)):
        root = components(links)
        many = groups.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 2")  # the one pair of a group of two has been compared
        named = stash(groups.join(many.hint("merge"), "bucket").join(root.hint("merge"), "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("label")))
        # groups led by one component meet as one, by the class of that component that most were found like
        liked = links.groupBy("to").agg(F.count("*").alias("by")).join(root.withColumnRenamed("node", "to").hint("merge"), "to", "left")
        liked = liked.groupBy(F.coalesce("root", "to").alias("label")).agg(F.sum("by").alias("likes"), F.max(F.struct("by", "to"))["to"].alias("middle"))
        shares = named.groupBy("bucket", "label").agg(F.count("*").alias("of")).join(liked.hint("merge"), "label", "left")
        lead = F.max(F.struct("of", F.coalesce("likes", F.lit(0)), F.coalesce("middle", "label").alias("to")))["to"]
        mixed = stash(shares.groupBy("bucket").agg(F.count("*").alias("labels"), lead.alias("to")).where("labels > 1").select("bucket", "to"))
        if mixed.isEmpty():
            return links
        open_ = named.join(mixed.hint("merge"), "bucket")
        if not left:
            break
        members = stash(open_.select("to", "node", "label").distinct())
        sized = stash(members.join(kept.select("node", F.length("text").alias("chars")).hint("merge"), "node").groupBy("to").agg(F.count("*").alias("n"), F.ceil(F.sum("chars") / part).cast("int").alias("parts")))
        first_ones = with_first(members, sized, "label", "parts", "mark").mapInArrow(_heads(shingle, least), "to long, part long, node long, label long, mark binary, size long, head binary")
        met = stash(first_ones.repartition(p, "to", "part").sortWithinPartitions("to", "part").mapInArrow(_meetings(least, hot), "bucket long, node long, to long").distinct())
        links = links.union(compared(met))
        groups = met.where("bucket IS NOT NULL")
        if groups.isEmpty():
            return links
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = open_.select("bucket", "node", "label", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    dealt = dealt.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "label", "node").join(kept.select("node", "text").hint("merge"), "node")
    dealt = dealt.select("bucket", "i", "j", "block", "label", "node", "text").repartition(p, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return links.union(stash(dealt.mapInArrow(_with_others(shingle, least), "node long, to long")))


def similar_components(docs: DataFrame, shingle: int, least: float, **limits: int) -> DataFrame:
    """(doc_id, thash, component_id) for each document: components of the texts whose sets of shingles have a Jaccard
    similarity of `least` or more, of all pairs whose fingerprints meet and are close."""
    found = stash(shingled(docs, shingle, least))
    one = F.struct("thash", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    classes = stash(found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(one).alias("one"), F.min("mark").alias("mark")))
    reach = components(similar_links(docs, classes.select("node", "one", "mark"), shingle, least, **limits))
    member = stash(classes.select("node", "rep").join(reach.hint("merge"), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")))
    named = with_least(member).select("node", "component_id")
    return found.select("doc_id", "thash", "node").join(named.hint("merge"), "node").select("doc_id", "thash", "component_id")


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id, with its columns. Rows with its id and text are one
    document; a component without any id keeps one row of each text."""
    none = F.lit(NO_ID)
    key = fresh(docs.columns, "id_", "th_")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", none).alias(key[0]), F.col("thash").alias(key[1])).distinct()
    marked = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), none), key[1]: text_hash()})
    return marked.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def survivors(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One document of each component of fingerprints."""
    return _one_of_each(docs, near_components(docs, shingle, bits))


def dissimilar(docs: DataFrame, shingle: int = 5, least: float = 0.8, **limits: int) -> DataFrame:
    """One document of each component of texts whose sets of shingles have a Jaccard similarity of `least` or more; limits as of similar_links."""
    return _one_of_each(docs, similar_components(docs, shingle, least, **limits))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
