"""Connected components of links between long ids, without gathering them anywhere.

Large-star and small-star rounds (Kiveris et al., 2014) over a table of links, after each task has
contracted its own links. Links point from the larger id to the smaller. Every round is a grouped minimum,
combined before the shuffle and stored, and a join of stored tables, which adaptive execution can split
where many links share a node; the loop ends when a round changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

CHUNK = 1_000_000
#: Tasks that the members of one large component are dealt to.
SALTS = 16


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        differ = low != high
        if not differ.any():
            break
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as a-b, one for each node that is not its component's smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(ids), at[: len(a)], at[len(a) :])
    rest = root != np.arange(len(ids))
    return ids[rest], ids[root[rest]]


def _contracted(batches):
    held, size = [], 0

    def out():
        a, b = contract(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            size += batch.num_rows
        if size >= CHUNK:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """links: two long columns, no nulls. Returns (node, root), root the smallest id reachable, for each linked node
    but the roots themselves."""
    a, b = links.columns
    edges = stash(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").mapInArrow(_contracted, "a long, b long"))
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
        # large-star: each node goes to the smallest neighbour that its own smaller neighbour has
        least = stash(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(least.withColumnRenamed("a", "b").hint("merge"), "b", "left")
        edges = stash(moved.select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small-star: each node and its smaller neighbours go to the smallest of these
        least = stash(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(moved.union(least.select("a", F.col("m").alias("b"))).distinct())


def with_least(member: DataFrame) -> DataFrame:
    """member (root, rep, ..) with component_id, the least rep of the rows of each root. Only roots of several rows are
    joined back, and those of a hot one are dealt to several tasks."""
    ids = member.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = [c for c in member.columns if c != "root"]
    salted = member.withColumn("salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    least = F.coalesce("component_id", "rep").alias("component_id")
    return salted.join(ids.hint("merge"), ["root", "salt"], "left").select(*member.columns, least)
