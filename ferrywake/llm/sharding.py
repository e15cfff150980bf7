"""Sharding by histogram sort, under the law of bytes: shards of near equal size in one total order.

The order is that of (hash of the text, id, place), so equal texts lie next to each other, are parted only
where a boundary must fall among them, and a text that a third of all rows share still spreads over shards,
as do rows that agree in text and id: the place is a number of each row's own, given when the keys are stored.
Each round counts, exactly and over every row, the bytes and rows between neighbouring probe keys, and
takes new probes from the rows of the cells that hold an open boundary; a boundary closes when a probe
meets its target within the tolerance or when no row is left between its neighbours. Then rows are
exchanged once, by cell; places come from the exact row counts below each cell, so no shard is one task.
What reaches the driver is bounded by the number of cells, not by the rows.

Defined results: a null text has no bytes and a CRC of 0, and counts as equal to the empty text; a null
id sorts before all ids; rows that agree in both are in any order among themselves and parted like any
others; an empty table gives no rows. With more shards than rows some shards stay empty.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, stash, table

#: Sampled keys of a cell in each round; at most this many times the cells come to the driver, and there are at most
#: SAMPLES + 3 times as many cells as boundaries.
SAMPLES = 4
#: Rows that a task counts at once.
HELD = 1_000_000
LEAST = -(1 << 63)


Key = tuple[int, int, int]


def _cells(key: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted probes are at or below each key; both are given by their parts, the first the most significant."""
    low, high = np.searchsorted(probes[0], key[0], "left"), np.searchsorted(probes[0], key[0], "right")
    if len(key) == 1:
        return high
    tied = np.flatnonzero(high > low)
    tied = tied[np.argsort(low[tied], kind="stable")]
    new = np.flatnonzero(np.append(True, low[tied][1:] != low[tied][:-1])) if len(tied) else tied
    for mine in np.split(tied, new[1:]) if len(tied) else []:
        a, b = low[mine[0]], high[mine[0]]
        low[mine] = a + _cells([x[mine] for x in key[1:]], [x[a:b] for x in probes[1:]])
    return low


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _counted(keys: DataFrame, probes: list[Key]) -> dict[str, list]:
    """For each cell between probes and part of it: bytes, rows, least and greatest key, and one of its keys."""
    sorted_ = [np.array([p[i] for p in probes], np.int64) for i in range(3)]

    def work(batches):
        held, rows = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                rows += b.num_rows
            if not rows or b is not None and rows < HELD:  # many rows at a time, for few rows out
                continue
            *key, size = (np.concatenate([x[i] for x in held]) for i in range(4))
            held, rows = [], 0
            mix, own = (_mixed(key[0], x) for x in key[1:])  # the place decides among rows alike, and nothing else
            cell, part = _cells(key, sorted_), (mix % np.uint64(SAMPLES)).astype(np.int64)
            at = np.lexsort((*key[::-1], part, cell))
            cell, part, size, mix, own = cell[at], part[at], size[at], mix[at], own[at]
            key = [x[at] for x in key]
            new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
            last = np.append(new[1:], len(cell)) - 1
            some = np.lexsort((own, mix, part, cell))[new]  # of each part the key of the least mix
            out = [cell[new], part[new], np.add.reduceat(size, new), last + 1 - new, mix[some].view(np.int64), own[some].view(np.int64)]
            out += [x[y] for y in (some, new, last) for x in key]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], COUNTED)

    got = keys.select("__h", "__d", "__t", "__size").mapInArrow(work, ", ".join(f"{c} long" for c in COUNTED))
    low, high = (F.struct(f"{x}h", f"{x}d", f"{x}t") for x in "lg")
    one = got.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min_by(F.struct("h", "d", "t"), F.struct("mix", "own")).alias("key"), F.min(low).alias("low"), F.max(high).alias("high"))
    flat = [F.col(f"{x}.{y}").alias(f"{x}_{y}") for x, own in (("key", "hdt"), ("low", ("lh", "ld", "lt")), ("high", ("gh", "gd", "gt"))) for y in own]
    return one.select("cell", "bytes", "n", *flat).toArrow().to_pydict()  # at most SAMPLES rows for each cell


COUNTED = ["cell", "part", "bytes", "n", "mix", "own", "h", "d", "t", "lh", "ld", "lt", "gh", "gd", "gt"]


def splitters(keys: DataFrame, cells: int, tolerance: float) -> tuple[list[Key], list[int]]:
    """Boundaries that part the bytes into `cells` near equal cells, and the rows below each cell."""
    total = keys.agg(F.sum("__size")).first()[0]
    if not total:
        return [], [0]
    targets = [total * j // cells for j in range(1, cells)]
    slack = tolerance * total / cells
    spread = 4 * cells
    probes = [(LEAST + (1 << 64) * i // spread, LEAST, LEAST) for i in range(1, spread)]
    chosen: dict[int, Key] = {}
    while True:
        size, n, keys_of, low, high = {}, {}, {}, {}, {}
        got = _counted(keys, probes)
        for c, bytes_, rows_, *k in zip(*got.values()):
            size[c], n[c] = size.get(c, 0) + bytes_, n.get(c, 0) + rows_
            keys_of.setdefault(c, []).append(tuple(k[:3]))
            low[c] = min(low.get(c, tuple(k[3:6])), tuple(k[3:6]))
            high[c] = max(high.get(c, tuple(k[6:])), tuple(k[6:]))
        below, rows = [0], [0]  # below[i]: bytes below probe i - 1
        for c in range(len(probes) + 1):
            below.append(below[-1] + size.get(c, 0))
            rows.append(rows[-1] + n.get(c, 0))
        under = np.array(below[1:-1])
        if len(chosen) == len(targets):
            place = {p: i for i, p in enumerate(probes)}
            cut = [chosen[j] for j in range(len(targets))]
            return cut, [0, *(rows[1 + place[p]] for p in cut)]
        new = set(chosen.values())
        for j, target in enumerate(targets):
            if j in chosen:
                continue
            i = int(np.searchsorted(under, target))  # probes[i] is the first at or above the target
            near = [k for k in (i - 1, i) if 0 <= k < len(probes)]
            best = min(near, key=lambda k: abs(int(under[k]) - target))
            if abs(int(under[best]) - target) <= slack:
                chosen[j] = probes[best]
            elif low[i] == high[i]:  # one row fills the cell: the boundary goes before or after it
                chosen[j] = low[i] if target - below[i] <= below[i + 1] - target else (*low[i][:2], low[i][2] + 1)
            else:
                new.update(keys_of[i])
                new.add(high[i])
                new.update(probes[k] for k in near)
            if j in chosen:
                new.add(chosen[j])
        probes = sorted(new)


def assign(rows: DataFrame, shards: int, tolerance: float = 0.01, cell_bytes: int = 1 << 30) -> DataFrame:
    """rows: with __h, __d, __t (the key, of which no two rows have the same) and __size. Adds shard and slot, and exchanges
    the rows once, whole. A shard is exchanged as several cells, of about cell_bytes where the driver's bound of 4096 allows."""
    keys = rows.select("__h", "__d", "__t", "__size")
    total = keys.agg(F.sum("__size")).first()[0] or 0
    each = min(max(8, total // shards // cell_bytes), max(8, 4096 // shards))
    cuts, rows_below = splitters(keys, shards * each, tolerance)
    sorted_ = [np.array([p[i] for p in cuts], np.int64) for i in range(3)]
    schema = T.StructType([*rows.schema.fields, T.StructField("__cell", T.IntegerType())])
    names = rows.columns

    def number(batches):
        for b in batches:
            key = [b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("__h", "__d", "__t")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_cells(key, sorted_).astype(np.int32))], [*names, "__cell"])

    celled = rows.mapInArrow(number, schema)
    spread = celled.repartitionByRange(max(1, len(cuts) + 1), "__cell")
    first = [rows_below[c] - rows_below[c // each * each] for c in range(len(rows_below))]
    order = Window.partitionBy("__cell").orderBy("__h", "__d", "__t")
    starts = F.array(*[F.lit(x).cast("long") for x in first])
    placed = spread.withColumn("shard", F.floor(F.col("__cell") / each).cast("int")).withColumn("slot", (F.element_at(starts, F.col("__cell") + 1) + F.row_number().over(order) - 1).cast("long"))
    return placed.drop("__cell")


def shard(docs: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
    """docs (doc_id, text) as doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = only(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__h"),
        F.coalesce("doc_id", F.lit(LEAST)).alias("__d"),
        F.monotonically_increasing_id().alias("__t"),  # fixed once it is stored
    )
    keyed = stash(keyed.withColumn("__size", F.col("size")))
    return assign(keyed, shards, tolerance).drop("__h", "__d", "__t", "__size")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
