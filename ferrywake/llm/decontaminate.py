"""Benchmark decontamination by greedy string tiling.

Each document is tokenised into lower-case words and rolled over once with a Karp-Rabin hash of `least`
words; windows whose hash is that of a benchmark window join the two on shared seeds. For every item so
met, the longest common run of unmarked words is marked again and again, in the document and in the item,
until no run of `least` words is left. The marked share of the item's words is its coverage: passages
found whole, in parts, or with their parts reordered all count. A document is contaminated if it covers
at least `coverage` of some item.

Documents are not exchanged. What is sent to the executors has a bound that does not depend on the tables: a
benchmark of at most `block` words goes to them whole; a larger one goes in blocks of that size (one item of
more words is a block of its own), one at a time, and what the documents share with each is stored and joined
back by id and hash of the text. Seeds that many items hold are followed item by item, and runs of words that
repeat in both texts diagonal by diagonal, so that no list of all pairs of places is built.

Defined results: null and empty texts, of documents or items, match nothing; an item of fewer than
`least` words must appear whole; items or documents that repeat each count; a null item_id takes part and
is reported as null; ties between equal runs go to the earliest in the item, then in the document.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, only, slices, stash, table

WORD = re.compile(r"\w+")
LEAST = 5
COVERAGE = 0.8
BLOCK = 2_000_000
#: Pairs of places listed at once.
PAIRS = 2_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each window of k word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * ODD
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + x[i : i + n]
    return h


def tiles(item: np.ndarray, doc: np.ndarray, least: int, at: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), longest first. at: doc windows to consider."""
    least = min(least, len(item))
    if not least:
        return []
    mine = rolled(item, least)
    order = np.argsort(mine, kind="stable")
    theirs = rolled(doc, least)
    at = np.arange(len(theirs)) if at is None else at
    low, high = np.searchsorted(mine[order], theirs[at], "left"), np.searchsorted(mine[order], theirs[at], "right")
    n = high - low
    if n.sum() > PAIRS:
        heap = _by_diagonal(item, doc, least)
    else:
        d = np.repeat(at, n)
        i = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(d) else d
        for k in range(least):  # a hash is only a seed
            same = item[i + k] == doc[d + k]
            i, d = i[same], d[same]
        if not len(i):
            return []
        by = np.lexsort((i, i - d))
        i, d = i[by], d[by]
        new = np.flatnonzero(np.append(True, (np.diff(i - d) != 0) | (np.diff(i) != 1)))
        size = np.diff(np.append(new, len(i))) + least - 1
        heap = [(-int(z), int(a), int(b)) for z, a, b in zip(size, i[new], d[new])]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        z, a, b = heapq.heappop(heap)
        taken = in_item[a : a - z] | in_doc[b : b - z]
        if not taken.any():
            in_item[a : a - z] = in_doc[b : b - z] = True
            out.append((a, b, -z))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):  # the runs still free
            if e - s >= least:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return out


def _by_diagonal(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs of `least` or more words that the two share: (-length, start in item, start in doc)."""
    out = []
    for shift in range(least - len(item), len(doc) - least + 1):
        a, b = max(0, -shift), max(0, shift)
        n = min(len(item) - a, len(doc) - b)
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = item[a : a + n] == doc[b : b + n]
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= least:
                out.append((s - e, a + s, b + s))
    return out


class Block:
    """Some benchmark items, indexed by the hashes of their windows."""

    def __init__(self, items: list[tuple[int | None, list[str]]], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64) for _, ws in items]
        self.seeds = {}
        for k in sorted({min(least, len(x)) for x in self.items} - {0}):
            mine = [(rolled(x, k), j) for j, x in enumerate(self.items) if min(least, len(x)) == k]
            h, j = np.concatenate([x for x, _ in mine]), np.concatenate([np.full(len(x), j) for x, j in mine])
            by = np.argsort(h, kind="stable")
            self.seeds[k] = h[by], j[by]

    def match(self, texts: list[str | None]) -> list[list[tuple[int | None, float]]]:
        """Items met by each text, with their coverage."""
        get = self.vocab.get
        tokens = [words(t) for t in texts]
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        start = np.append(0, np.cumsum(size))
        flat = np.fromiter((get(w, -1) for ws in tokens for w in ws), np.int64, start[-1])
        out: list[list] = [[] for _ in texts]
        for k, (h, j) in self.seeds.items():
            theirs = rolled(flat, k)
            known = flat >= 0
            whole = np.ones(len(theirs), bool)
            for i in range(k):
                whole &= known[i : i + len(theirs)]
            at = np.flatnonzero(whole)
            low = np.searchsorted(h, theirs[at], "left")
            hit = (low < len(h)) & (h[np.minimum(low, len(h) - 1)] == theirs[at])
            at, low = at[hit], low[hit]
            n = np.searchsorted(h, theirs[at], "right") - low
            doc = np.searchsorted(start, at, "right") - 1
            inside = at + k <= start[doc + 1]
            at, low, n, doc = at[inside], low[inside], n[inside], doc[inside]
            ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else doc
            sums = np.append(0, np.cumsum(n))
            a = 0
            while a < len(at):  # some documents at a time
                b = ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(sums[ends], sums[a] + PAIRS, "right") - 1)]
                if sums[b] - sums[a] > PAIRS:
                    met = self._one_by_one(k, theirs, at[a:b], low[a:b], n[a:b])
                    pairs = ((int(doc[a]), j_, at_) for j_, at_ in met)
                else:
                    pairs = self._listed(j, at[a:b], low[a:b], n[a:b], doc[a:b])
                for d, j_, at_ in pairs:
                    x = self.items[j_]
                    got = tiles(x, flat[start[d] : start[d + 1]], self.least, at_ - start[d])
                    if got:
                        out[d].append((self.ids[j_], sum(z for _, _, z in got) / len(x)))
                a = b
        return out

    def _listed(self, j: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray, doc: np.ndarray):
        """(document, item, places) of seeds, by way of a list of all pairs of seed and item."""
        item = j[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        by = np.lexsort((at, item, doc))
        at, item, doc = at[by], item[by], doc[by]
        new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0)))
        for a, b in zip(new, np.append(new[1:], len(at))):
            yield int(doc[a]), int(item[a]), np.unique(at[a:b])

    def _one_by_one(self, k: int, theirs: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray):
        """(item, places) of the seeds of one document, an item at a time."""
        _, j = self.seeds[k]
        met = np.zeros(len(self.items), bool)
        for a, m in {(int(a), int(m)) for a, m in zip(low, n)}:
            met[j[a : a + m]] = True
        for item in np.flatnonzero(met).tolist():
            yield item, at[np.isin(theirs[at], rolled(self.items[item], k))]


def blocks(benchmark: DataFrame, least: int, block: int):
    """The benchmark in blocks of bounded size; one at a time is in the driver's memory."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        ws = words(r[1])
        if held and size + len(ws) > block:
            yield Block(held, least)
            held, size = [], 0
        if ws:
            held.append((r[0], ws))
            size += len(ws)
    if held:
        yield Block(held, least)


HITS = "array<struct<item_id:bigint,coverage:double>>"


def _matched(docs: DataFrame, one: Block, hits: str) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(one)
    text, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(hits, T._parse_datatype_string(HITS))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))

    def work(batches):
        for b in slices(batches):
            got = sent.value.match(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[{"item_id": i, "coverage": c} for i, c in g] for g in got], kind)], schema.names)

    return docs.mapInArrow(work, schema), sent


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block: int = BLOCK, hits: str = "__hits") -> DataFrame:
    """docs with a column of the name `hits`: the benchmark items each document shares a run with, and how much of each it
    covers."""
    if hits.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column of the name {hits} is there already")
    todo = blocks(benchmark, least, block)
    one, other = next(todo, None), next(todo, None)
    if one is None:
        return docs.withColumn(hits, F.array().cast(HITS))
    if other is None:
        return _matched(docs, one, hits)[0]
    id_, th, got = fresh([*docs.columns, hits], "id_", "th_", "got_")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(id_), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(th)]
    found = None
    for part in chain([one, other], todo):
        rows, sent = _matched(docs.select(*key, "text"), part, hits)
        now = stash(rows.where(F.size(hits) > 0).select(id_, th, hits)).groupBy(id_, th).agg(F.first(hits).alias(hits))  # equal rows share the same
        sent.destroy()
        found = now if found is None else found.union(now)
    found = found.groupBy(id_, th).agg(F.flatten(F.collect_list(hits)).alias(got))
    marked = docs.select("*", *key).join(found.hint("merge"), [id_, th], "left")
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(got, F.array().cast(HITS)).alias(hits))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """The documents that cover no item up to the threshold, with their columns."""
    (hits,) = fresh(docs.columns, "hits_")
    found = overlaps(docs, benchmark, least, block, hits)
    return found.where(~F.exists(hits, lambda h: h["coverage"] >= coverage)).drop(hits)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.filter("__hits", lambda h: h["coverage"] >= COVERAGE)
    items = F.array_sort(F.transform(hit, lambda h: h["item_id"]))
    top = F.coalesce(F.array_max(F.transform("__hits", lambda h: h["coverage"])), F.lit(0.0))
    return found.select("doc_id", (F.size(items) > 0).alias("contaminated"), items.alias("item_ids"), F.size("__hits").cast("long").alias("n_touched"), top.alias("max_coverage"))
