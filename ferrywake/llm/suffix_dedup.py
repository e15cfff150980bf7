"""Removal of every byte covered by a long string that also starts anywhere else, by suffix order.

Every window of `length` bytes has an anchor, the rightmost least hash of its grams, so equal windows have
equal anchors wherever they stand. Neighbouring windows of one anchor form a segment. Segments are dealt
by anchor: an anchor met once repeats nothing, and a segment met twice byte for byte repeats throughout.
What is left, segments that share an anchor but differ, is settled by suffix order: the segments of a
bucket are sorted into a Burrows-Wheeler transform, and breadth-first backward extension of its intervals
derives the common prefixes by increasing value until the minimum length; the boundaries not reached by
then are the strings that repeat. No window is skipped and no group is cut short.

Anchors that hold many segments are found by a bounded sketch in each task. They are counted by segment
with partial sums, and joined back by salted keys. Should one anchor have over
`bucket` differing segments, its windows are counted by their digests instead of being held together.

Defined results: a null text is empty; matches never cross documents; a text of fewer than `length` bytes
loses nothing; rows that repeat, with or without an id, are occurrences of their own, so both lose what
they share; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, partitions, stash, table, texts_of

LENGTH = 200
GRAM = 24
ODD = 0x9E3779B97F4A7C15
LOW = (1 << 24) - 1


def _table() -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=2026)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of `gram` bytes (polynomial, built by doubling)."""
    part, size, power = _table()[data], 1, ODD
    out, done = None, 0
    left = gram
    while True:
        if left & 1:
            if out is None:
                out, done = part, size
            else:
                n = min(len(part) - done, len(out))
                out, done = out[:n] * np.uint64(power) + part[done : done + n], done + size
        left >>= 1
        if not left:
            break
        part = part[: len(part) - size] * np.uint64(power) + part[size:] if len(part) > size else part[:0]
        size, power = size * 2, power * power % (1 << 64)
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Cuts the window starts of each document into runs that share an anchor, the rightmost least gram of the window.

    Returns document, first start, number of starts, place of the anchor from the first start, and its hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = gram_hashes(data, gram)
    v = (h & ~np.uint64(LOW)) | (np.uint64(LOW) - np.arange(len(h), dtype=np.uint64))
    at = np.int64(LOW) - (_least(v, length - gram + 1) & np.uint64(LOW)).astype(np.int64)
    n = np.maximum(0, ends - starts - length + 1)
    doc = np.repeat(np.arange(len(starts)), n)
    s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    p = at[s]
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1]))) if len(p) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(p)))
    return doc[new], s[new], count, p[new] - s[new], h[p[new]]


#: Bytes cut at once; places must fit the bits of LOW.
AT_ONCE = 4_000_000
BUCKET = 12_000
CHUNK = 1_500_000
SKETCH = 4096
#: Tasks that the rows of one heavy segment are dealt to.
SALTS = 32
NO_ID = -(1 << 63)
ROW = "key long, ctx long, doc_id long, thash long, pos long"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, text): a row's identity is its id and the hash of its text; rows with equal ones are alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("thash"), text.alias("text"))


def _pieces(sizes: np.ndarray, length: int):
    """Runs of documents, or parts of a long one that overlap by a window less a byte: (first, last, start, end)."""
    i, n = 0, len(sizes)
    while i < n:
        if sizes[i] > AT_ONCE:
            for a in range(0, int(sizes[i]) - length + 1, AT_ONCE):
                yield i, i + 1, a, min(int(sizes[i]), a + AT_ONCE + length - 1)
            i += 1
            continue
        j, size = i, 0
        while j < n and sizes[j] <= AT_ONCE and (j == i or size + sizes[j] <= AT_ONCE):
            size += sizes[j]
            j += 1
        yield i, j, 0, -1
        i = j


def _cut(length: int):
    def work(batches):
        for b in batches:
            ids, th = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = texts_of(b.column(2))
            for i, j, a, e in _pieces(np.fromiter(map(len, texts), np.int64, len(texts)), length):
                part = [texts[i][a:e]] if e >= 0 else texts[i:j]
                buf = b"".join(part)
                ends = np.cumsum([len(x) for x in part])
                starts = np.append(0, ends[:-1])
                doc, s, n, anchor, h = segments(np.frombuffer(buf, np.uint8), starts, ends, length)
                if not len(s):
                    continue
                digest = hashlib.blake2b
                ctx = np.frombuffer(b"".join([digest(buf[x:y], digest_size=8).digest() for x, y in zip(s.tolist(), (s + n + length - 1).tolist())]), np.int64)
                pos = (s - starts[doc] + a) << 16 | n
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx ^ (anchor * 0x9E3779B97F4A7)), pa.array(ids[i:j][doc]), pa.array(th[i:j][doc]), pa.array(pos)], ["key", "ctx", "doc_id", "thash", "pos"])

    return work


def _heavy(batches):
    """Keys that this task meets often, by a Misra-Gries summary of bounded size."""
    seen: dict[int, int] = {}
    for b in batches:
        k, n = np.unique(b.column(0).to_numpy(), return_counts=True)
        if len(k) > SKETCH:
            top = np.argpartition(n, -SKETCH)[-SKETCH:]
            k, n = k[top], n[top]
        for x, c in zip(k.tolist(), n.tolist()):
            seen[x] = seen.get(x, 0) + c
        if len(seen) > 4 * SKETCH:
            least = sorted(seen.values())[-SKETCH]
            seen = {x: c - least for x, c in seen.items() if c > least}
    top = sorted(seen.items(), key=lambda x: -x[1])[:SKETCH]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.int64()), pa.array([c for _, c in top], pa.int64())], ["key", "n"])


def _settled(batches):
    """Over rows sorted by key and ctx: segments that repeat whole (kind 0), and one of each of those whose anchor has
    others (kind 1: met once, 2: met more often)."""

    def done(x):
        k, c = x[0], x[1]
        new_key = np.append(True, k[1:] != k[:-1])
        new = new_key | np.append(True, c[1:] != c[:-1])
        of_key = np.cumsum(new_key) - 1
        of_ctx = np.cumsum(new) - 1
        met = np.bincount(of_ctx)[of_ctx]
        differ = np.bincount(of_key[new])[of_key] > 1
        full, rep = met > 1, new & differ
        at = np.concatenate([np.flatnonzero(full), np.flatnonzero(rep)])
        kind = np.concatenate([np.zeros(full.sum(), np.int32), np.where(met[rep] > 1, 2, 1).astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(v[at]) for v in x)], ["kind", "key", "ctx", "doc_id", "thash", "pos"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([b.column(i).to_numpy() for i in range(5)])
        if held is not None:
            x = np.concatenate([held, x], axis=1)
        last = int(np.searchsorted(x[0], x[0, -1], "left"))
        if last:
            yield done(x[:, :last])
        held = x[:, last:]
    if held is not None:
        yield done(held)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes ordered by their first `depth` bytes at least (of equal ones in any order)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + n]
    order = np.argsort(word, kind="stable")
    new = np.append(True, word[order][1:] != word[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    known = 8
    while known < depth:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows of groups of more than one
        if not len(at):
            break
        rows = order[at]
        key = rank[rows] * (n + 1) + rank[np.minimum(rows + known, n)] + 1
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        order[at] = rows
        new[at] = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = start
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each boundary between neighbours in the order, their common prefix if under `length`, else -1.

    Intervals of the Burrows-Wheeler transform are extended backwards breadth-first: a boundary is set by the
    first interval that ends there, which is when the prefixes have the interval's length (Beller et al.). The
    data must end in a byte that is found nowhere else."""
    n = len(data)
    bwt = data[order - 1]
    first = np.empty(n, np.int64)
    first[np.argsort(bwt, kind="stable")] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int32)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for value in range(length):
        if not len(low):
            break
        n_low, n_high = [], []
        size = high - low
        ends = np.cumsum(size)
        a = 0
        while a < len(low):  # some intervals at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 4_000_000, "right")))
            m = size[a:b]
            iv = np.repeat(np.arange(b - a), m)
            row = np.arange(len(iv)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[a:b], m)
            by = np.argsort(iv * 256 + bwt[row], kind="stable")
            row, key = row[by], (iv * 256 + bwt[row])[by]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            last = np.append(start[1:], len(key)) - 1
            n_low.append(first[row[start]])
            n_high.append(first[row[last]] + 1)
            a = b
        low, high = np.concatenate(n_low), np.concatenate(n_high)
        go = unset[high]
        low, high = low[go], high[go]
        unset[high] = False
        lcp[high] = value
    return lcp


def repeated(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the starts of its windows that are also a window of another or elsewhere in it."""
    data = np.frombuffer(b"".join(c + b"\xff" for c in contexts) + b"\xfe", np.uint8)  # neither byte is in UTF-8
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    end = np.cumsum(size + 1) - 1
    order = suffix_order(data, length)
    lcp = common_prefixes(data, order, length)
    n = len(data)
    open_ = lcp < 0
    open_[0] = open_[n] = False
    hit = np.zeros(n, bool)
    hit[order[open_[:n] | open_[1:]]] = True
    hit[-1] = False
    hit[:-1] &= np.arange(n - 1) + length <= np.repeat(end, size + 1)
    at = np.flatnonzero(hit)
    cut = np.searchsorted(at, np.append(0, end + 1))
    return [at[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], end - size)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    new = np.flatnonzero(np.append(True, np.diff(starts) != 1))
    return [(int(starts[a]), int(b - a)) for a, b in zip(new, np.append(new[1:], len(starts)))]


def _fetched(length: int):
    """The bytes of segments: rows (doc_id, thash, text, want) where want lists (key, kind, pos)."""

    def work(batches):
        for b in batches:
            out = []
            for d, h, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist()):
                for w in want:
                    s, n = w["pos"] >> 16, w["pos"] & 0xFFFF
                    out.append((w["key"], w["kind"], d, h, w["pos"], t[s : s + n + length - 1]))
            for i in range(0, len(out), 8192):
                part = out[i : i + 8192]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], kinds[c]) for c in range(6)], ["key", "kind", "doc_id", "thash", "pos", "bytes"])

    return work


def _ordered(length: int, bucket: int):
    """Over contexts sorted by key: (doc_id, thash, pos) of runs of repeated windows; those of a key with over `bucket`
    contexts are passed on with their bytes."""

    def work(batches):
        held: list = []
        size = 0
        large = None

        def pack(rows):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], ["doc_id", "thash", "pos", "key", "kind", "bytes"])

        def done(rows):
            out = []
            if len(rows) > 1:
                for r, starts in zip(rows, repeated([r[5] for r in rows], length)):
                    if r[1] == 1:
                        out += [(r[2], r[3], (r[4] >> 16) + s << 16 | n, None, None, None) for s, n in _runs(starts)]
            return pack(out)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if r[0] == large:
                    yield pack([(r[2], r[3], r[4], r[0], r[1], r[5])])
                    continue
                if held and r[0] != held[-1][0] and size >= CHUNK:
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
                if len(held) > bucket and held[-bucket - 1][0] == r[0]:
                    mine = [x for x in held if x[0] == r[0]]
                    yield pack([(x[2], x[3], x[4], x[0], x[1], x[5]) for x in mine])
                    held = [x for x in held if x[0] != r[0]]
                    size, large = sum(len(x[5]) for x in held), r[0]
        if held:
            yield done(held)

    return work


def _windows(length: int):
    """Digest and place of every window of the contexts passed on."""

    def work(batches):
        for b in batches:
            for d, h, pos, key, kind, raw in zip(*(b.column(i).to_pylist() for i in range(6))):
                s, n = pos >> 16, pos & 0xFFFF
                digest = np.frombuffer(b"".join(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
                full = np.full(n, 1)
                yield pa.RecordBatch.from_arrays([pa.array(full * d), pa.array(full * h), pa.array((s + np.arange(n)) << 16 | 1), pa.array(full.astype(np.int32) * kind), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["doc_id", "thash", "pos", "kind", "w1", "w2"])

    return work


def repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, thash, text) and, for those that repeat something, (doc_id, thash, spans): runs of repeated window
    starts, as start << 16 | count."""
    spark = docs.sparkSession
    p = partitions(spark)
    rows = _rows(docs)
    segs = stash(rows.mapInArrow(_cut(length), ROW))
    total = segs.count()
    often = segs.select("key").mapInArrow(_heavy, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2000, total // (4 * p)))
    heavy = [r.key for r in often.select("key").collect()]  # at most four for each partition, and what one sketch errs by
    light = segs
    if heavy:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in heavy], "key long"))
        light = segs.join(keys, "key", "left_anti")
    settled = light.repartition(p, "key").sortWithinPartitions("key", "ctx").mapInArrow(_settled, f"kind int, {ROW}")
    if heavy:
        hot = segs.join(keys, "key", "left_semi")
        met = stash(hot.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "thash", "pos")).alias("rep")))
        differ = F.broadcast(met.groupBy("key").agg(F.count("*").alias("d")).where("d > 1").select("key"))  # no more rows than heavy keys
        # a passage that a third of all rows hold is one key and ctx: its rows are dealt to several tasks, and what repeats is sent to each
        dealt = hot.withColumn("salt", F.pmod(F.xxhash64("doc_id", "thash", "pos"), F.lit(SALTS)).cast("int"))
        often_met = met.where("n > 1").select("key", "ctx", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        full = dealt.join(often_met.hint("merge"), ["key", "ctx", "salt"], "left_semi").select(F.lit(0).alias("kind"), *segs.columns)
        reps = met.join(differ, "key", "left_semi").select(F.when(F.col("n") > 1, 2).otherwise(1).alias("kind"), "key", "ctx", "rep.doc_id", "rep.thash", "rep.pos")
        settled = settled.union(full).union(reps)
    settled = stash(settled)
    want = settled.where("kind > 0").groupBy("doc_id", "thash").agg(F.collect_set(F.struct("key", "kind", "pos")).alias("want"))
    fetched = rows.join(want.hint("merge"), ["doc_id", "thash"]).select("doc_id", "thash", "text", "want").mapInArrow(_fetched(length), "key long, kind int, doc_id long, thash long, pos long, bytes binary")
    ordered = fetched.repartition(p, "key").sortWithinPartitions("key").mapInArrow(_ordered(length, bucket), "doc_id long, thash long, pos long, key long, kind int, bytes binary")
    ordered = stash(ordered)
    found = settled.where("kind = 0").select("doc_id", "thash", "pos").union(ordered.where("key is null").select("doc_id", "thash", "pos"))
    large = ordered.where("key is not null").select("doc_id", "thash", "pos", "key", "kind", "bytes")
    if not large.isEmpty():
        windows = stash(large.mapInArrow(_windows(length), "doc_id long, thash long, pos long, kind int, w1 long, w2 long"))
        again = windows.groupBy("w1", "w2").agg(F.sum("kind").alias("n")).where("n > 1").select("w1", "w2")
        found = found.union(windows.where("kind = 1").join(again.hint("merge"), ["w1", "w2"], "left_semi").select("doc_id", "thash", "pos"))
    return rows, found.groupBy("doc_id", "thash").agg(F.collect_set("pos").alias("spans"))


def removed(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows."""
    if not spans:
        return []
    x = np.sort(np.array(spans, np.int64))
    start, end = x >> 16, (x >> 16) + (x & 0xFFFF) + length - 1
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[new].tolist(), reach[np.append(new[1:], len(x)) - 1].tolist()))


def dedup(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text, kept, runs): the bytes of each text, those kept, and the maximal removed runs."""
    rows, spans = repeats(docs, length, bucket)

    def work(batches):
        for b in batches:
            texts, kept, runs_ = texts_of(b.column(1)), [], []
            for t, s in zip(texts, b.column(2).to_pylist()):
                cut = removed(s, length)
                runs_.append([{"start": a, "end": e} for a, e in cut])
                if cut:
                    t = b"".join(t[a:e] for a, e in zip([0, *(e for _, e in cut)], [*(a for a, _ in cut), len(t)]))
                kept.append(t)
            doc = pa.array(b.column(0).to_numpy(zero_copy_only=False), mask=b.column(0).to_numpy(zero_copy_only=False) == NO_ID)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(runs_, kind)], ["doc_id", "n_bytes", "kept", "runs"])

    joined = rows.join(spans.hint("merge"), ["doc_id", "thash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, kept binary, runs array<struct<start:bigint,end:bigint>>")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
