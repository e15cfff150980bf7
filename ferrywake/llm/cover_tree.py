"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Unit vectors are compared by their distance, sqrt(2 - 2 cosine). Equal vectors (by a digest of 128 bits) are one
class with a weight. Classes are dealt to cells around pivots (a hashed sample of bounded number; no row is left out);
a cell of over `unit` classes is cut into units of the same centre. Each unit holds its own classes in a
cover tree of nested levels with halving radii and streams the classes of other units past it, a batch
and its own tree at a time: pairs of nodes whose centres lie further apart than both covering radii and
the threshold are pruned, pairs that lie within it whatever their points are linked at once, and the rest
are opened until single vectors remain, for which the cosine decides. The levels are nested from radius 1/2 down:
no pair of nodes of radius 1 or 2 is ever pruned, as unit vectors lie no further than 2 apart, so the root's
children are met at once and by matrix products. A class visits a unit only if the
covering radius and the plane between the two centres allow a link; each pair of units meets once.

A link of a dense group is never written out by pairs: counts are added by ranges of the tree, and a
component is passed on as a link from each node to one other.

Vectors without any structure leave nothing to prune above single vectors: then the work is that of
comparing all pairs, in blocks, as for any exact method.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing; vectors of different lengths do not link; rows that repeat link with each other; a row with a
null vec_id counts as a link of others but has no component of its own (null). An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, partitions, slices, stash, table
from .graph import components, contract, local_roots, with_least

SLACK = 1e-9
#: Least radius of a node of several points: the distance of nearly equal vectors is measured no finer than this.
FINEST = 1e-7
#: More than single precision can be off in a cosine of unit vectors.
COARSE = np.float32(1e-4)
UNIT = 16384
PIVOTS = 4096
BATCH = 4096
#: Pairs of nodes whose distance is measured at once.
PAIRS = 32_768
#: Links held before they are contracted.
LINKS = 2_000_000


class Tree:
    """Nodes over unit vectors: centre, covering radius (0 for single points only), children, and the range of their points in `order`."""

    def __init__(self, x: np.ndarray, top: float = 0.5):
        self.x, self.coarse = x, x.astype(np.float32)
        n = len(x)
        centre, radius, low, high, kids = [], [], [], [], []
        order = np.arange(n)

        def node(points: np.ndarray, at: int, c: int) -> int:
            d = _far(x[points], x[c][None])[:, 0]
            centre.append(c)
            radius.append(max(float(d.max()), FINEST) if len(points) > 1 else 0.0)
            low.append(at)
            high.append(at + len(points))
            kids.append(None)
            order[at : at + len(points)] = points
            return len(centre) - 1

        def split(points: np.ndarray, at: int, r: float) -> list[int]:
            out = []
            for c, mine in _net(self.coarse, points, r):
                out.append(node(mine, at, c))
                at += len(mine)
            return out

        self.roots = split(np.arange(n), 0, top)
        todo = [(k, top / 2) for k in self.roots]
        while todo:
            k, r = todo.pop()
            if radius[k] <= 0.0:
                continue
            while r > radius[k]:  # levels that would hold a single node
                r /= 2
            points = order[low[k] : high[k]].copy()
            if r < FINEST:  # equal but for rounding: single points
                kids[k] = [node(points[i : i + 1], low[k] + i, points[i]) for i in range(len(points))]
                continue
            kids[k] = split(points, low[k], r)
            todo.extend((c, r / 2) for c in kids[k])
        self.centre, self.radius, self.low, self.high = (np.array(v) for v in (centre, radius, low, high))
        n_kids = np.array([len(c) if c else 0 for c in kids], np.int64)
        self.kid_at = np.append(0, np.cumsum(n_kids))
        self.kids = np.array([c for cs in kids if cs for c in cs], np.int64)
        self.order = order
        self.roots = np.array(self.roots, np.int64)

    def open(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of each node (a node without any is its own), and which of the nodes each is of."""
        n = self.kid_at[nodes + 1] - self.kid_at[nodes]
        leaf = n == 0
        m = np.maximum(n, 1)
        of = np.repeat(np.arange(len(nodes)), m)
        step = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        at = np.minimum(np.repeat(self.kid_at[nodes], m) + step, max(0, len(self.kids) - 1))
        kid = self.kids[at] if len(self.kids) else np.zeros(len(of), np.int64)
        return np.where(leaf[of], nodes[of], kid), of


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def _net(coarse: np.ndarray, points: np.ndarray, r: float):
    """Centres further than r apart, in the order of the points, each with the points within r of it and of none before.

    In single precision: a point near the border may go either way, and radii are measured afterwards."""
    least = np.float32(1 - r * r / 2)
    owner = np.full(len(points), -1)
    centres: list[int] = []
    at = 0
    while at < len(points):
        block = np.arange(at, min(at + 512, len(points)))
        at = block[-1] + 1
        if centres:
            for i in range(0, len(centres), 4096):
                free = block[owner[block] < 0]
                if not len(free):
                    break
                row, col = np.nonzero(coarse[points[free]] @ coarse[points[centres[i : i + 4096]]].T >= least)
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
                owner[free[row[first]]] = i + col[first]
        free = block[owner[block] < 0]
        if len(free):
            near = coarse[points[free]] @ coarse[points[free]].T >= least
            left = np.ones(len(free), bool)
            for i in range(len(free)):
                if left[i]:
                    mine = near[i] & left
                    mine[i] = True
                    owner[free[mine]] = len(centres)
                    left &= ~mine
                    centres.append(int(free[i]))
    by = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by], np.arange(len(centres) + 1))
    return [(int(points[c]), points[by[cut[k] : cut[k + 1]]]) for k, c in enumerate(centres)]


class Found:
    """Link counts by weight of the points of two trees, and links that join their components.

    In the links, points of the second tree are numbered after those of the first (unless both are one). They are
    contracted to a forest whenever many have gathered."""

    def __init__(self, a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray):
        self.a, self.b = a, b
        self.shift, self.n_links = 0 if a is b else len(a.order), 0
        self.sum_a, self.sum_b = (np.append(0, np.cumsum(w[t.order])) for w, t in ((wa, a), (wb, b)))
        self.add_a, self.add_b = np.zeros(len(wa) + 1, np.int64), np.zeros(len(wb) + 1, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def all_of(self, i: np.ndarray, j: np.ndarray) -> None:
        """Every point of the nodes i links with every point of the nodes j of the other tree."""
        a, b = self.a, self.b
        w = self.sum_b[b.high[j]] - self.sum_b[b.low[j]]
        np.add.at(self.add_a, a.low[i], w)
        np.add.at(self.add_a, a.high[i], -w)
        w = self.sum_a[a.high[i]] - self.sum_a[a.low[i]]
        np.add.at(self.add_b, b.low[j], w)
        np.add.at(self.add_b, b.high[j], -w)
        for t, nodes, c, other in ((a, i, b.centre[j], 0), (b, j, a.centre[i], 1)):
            n = t.high[nodes] - t.low[nodes]
            points = t.order[np.repeat(t.low[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            mine, theirs = (0, self.shift) if other == 0 else (self.shift, 0)
            self.links.append((points + mine, np.repeat(c, n) + theirs))
            self.n_links += len(points)
        if self.n_links > LINKS:
            self.links = [self.forest()]
            self.n_links = len(self.links[0][0])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """At most one link for each point, of the same components."""
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return contract(*(np.concatenate([p[i] for p in self.links]) for i in (0, 1)))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for t, add in ((self.a, self.add_a), (self.b, self.add_b)):
            c = np.empty(len(t.order), np.int64)
            c[t.order] = np.cumsum(add)[:-1]
            out.append(c)
        return out[0], out[1]


def dual(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool = False) -> Found:
    """All links between the points of two trees, or (same) within one: then each pair once, in either order."""
    reach = float(np.sqrt(2 - 2 * cosine))
    found = Found(a, b, wa, wb)
    # in single precision first, by a bound on the cosine that no pair within reach misses; points and wider nodes apart
    for wide_a in (False, True):
        top_a = a.roots[(a.radius[a.roots] > 0) == wide_a]
        for wide_b in (False, True):
            top_b = b.roots[(b.radius[b.roots] > 0) == wide_b]
            if same and wide_a and not wide_b:
                continue  # met the other way round
            theirs, rb = b.coarse[b.centre[top_b]], b.radius[top_b].astype(np.float32)
            for i in range(0, len(top_a), 1024):
                top = top_a[i : i + 1024]
                dot = a.coarse[a.centre[top]] @ theirs.T
                if wide_a or wide_b:
                    span = np.minimum(np.float32(2), a.radius[top].astype(np.float32)[:, None] + rb[None] + np.float32(reach))
                    x, y = np.nonzero(dot >= 1 - span * span / 2 - COARSE)
                else:
                    x, y = np.nonzero(dot >= np.float32(cosine - COARSE))
                p, q = top[x], top_b[y]
                if same and wide_a == wide_b:
                    p, q = p[p <= q], q[p <= q]
                _follow(found, p, q, cosine, reach, same)
    return found


def _follow(found: Found, i: np.ndarray, j: np.ndarray, cosine: float, reach: float, same: bool) -> None:
    a, b = found.a, found.b
    todo: list[tuple[np.ndarray, np.ndarray | int]] = [(i, j)]
    while todo:  # depth first and a bounded number of pairs at a time
        i, j = todo.pop()
        if not isinstance(j, np.ndarray):  # children of one node from a place on, each with itself and those behind it
            last = min(len(i), j + max(1, PAIRS // len(i)))
            n = len(i) - np.arange(j, last)
            p = np.repeat(np.arange(j, last), n)
            q = p + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            if last < len(i):
                todo.append((i, last))
            p, q = i[p], i[q]
            meet = (p != q) | (a.radius[p] > 0)  # a single point does not meet itself
            i, j = p[meet], q[meet]
        if not len(i):
            continue
        opened = np.maximum(a.kid_at[i + 1] - a.kid_at[i], b.kid_at[j + 1] - b.kid_at[j])
        if len(i) > 1 and len(i) + opened.sum() > 8 * PAIRS:
            half = len(i) // 2
            todo += [(i[half:], j[half:]), (i[:half], j[:half])]
            continue
        dot = np.einsum("ij,ij->i", a.x[a.centre[i]], b.x[b.centre[j]])
        d = np.sqrt(np.maximum(0.0, 2 - 2 * dot))
        ra, rb = a.radius[i], b.radius[j]
        single = (ra == 0) & (rb == 0)
        own = same & (i == j)
        link = np.where(single, dot >= cosine, d + ra + rb <= reach - SLACK) & ~own
        if link.any():
            found.all_of(i[link], j[link])
        go = ~link & ~single & (d <= ra + rb + reach + SLACK)
        go_own, go = go & own, go & ~own
        wide = ra[go] >= rb[go]
        ai, bj = i[go], j[go]
        k1, o1 = a.open(ai[wide])
        k2, o2 = b.open(bj[~wide])
        ni, nj = [k1, ai[~wide][o2]], [bj[wide][o1], k2]
        todo += [(a.kids[a.kid_at[k] : a.kid_at[k + 1]], 0) for k in i[go_own] if a.kid_at[k + 1] > a.kid_at[k]]
        todo.append((np.concatenate(ni), np.concatenate(nj)))


def _unit(row) -> np.ndarray | None:
    if row is None or not len(row) or any(v is None for v in row):
        return None
    x = np.array(row, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def units(rows: DataFrame) -> DataFrame:
    """(vec_id, unit, d1, d2): the unit vector as bytes, null where the vector can't link, and its digest of 128 bits."""

    def work(batches):
        for b in batches:
            out = [None if (v := _unit(x)) is None else v.tobytes() for x in b.column(1).to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v or b"") for v in out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), *(pa.array(digest[:, i].copy()) for i in (0, 1))], ["vec_id", "unit", "d1", "d2"])

    return only(rows, "vec_id", "embedding").mapInArrow(work, "vec_id long, unit binary, d1 long, d2 long")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _links_of_size(classes: DataFrame, n: int, size: int, cosine: float, unit: int, pivots: int) -> DataFrame:
    """classes (id, w, unit), n of them, all of vectors of one size. Rows (id, n, other): link counts to add up, and links."""
    reach = float(np.sqrt(2 - 2 * cosine))
    want = int(min(pivots, max(-(-n // unit), min(16, -(-n // 512)))))
    centres = _matrix(pa.array([bytes(r.unit) for r in classes.orderBy(F.xxhash64("id")).select("unit").limit(want).collect()]), size)

    def near(batches):
        for b in slices(batches):
            if b.num_rows:
                d = _far(_matrix(b.column(2), size), centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "far"])

    celled = stash(classes.mapInArrow(near, "id long, w long, unit binary, cell int, far double"))
    stats = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).orderBy("cell").collect()  # a row for each pivot
    first, radius = {}, np.full(len(centres), -1.0)
    of_unit: list[int] = []
    for s in stats:
        parts = -(-s.n // unit)
        first[s.cell] = (len(of_unit), parts)
        radius[s.cell] = s.r
        of_unit += [s.cell] * parts
    of_unit_ = np.array(of_unit)
    total = len(of_unit)
    between = _far(centres, centres)

    def deal(batches):
        for b in slices(batches):
            if not b.num_rows:
                continue
            x = _matrix(b.column(2), size)
            cell = b.column(3).to_numpy()
            ids = b.column(0).to_numpy()
            start, parts = (np.array([first[c][k] for c in cell]) for k in (0, 1))
            mine = start + ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
            d = _far(x, centres)
            own = d[np.arange(len(d)), cell]
            gap = between[cell]
            plane = np.where(gap > 0, (d**2 - own[:, None] ** 2) / np.maximum(2 * gap, 1e-12), 0.0)
            may = (d <= radius[None] + reach + SLACK) & (plane <= reach + SLACK) & (radius[None] >= 0)
            to = may[:, of_unit_]
            ahead = (np.arange(total)[None] - mine[:, None]) % total
            to &= (ahead > 0) & ((2 * ahead < total) | ((2 * ahead == total) & (np.arange(total)[None] > mine[:, None])))
            row, where = np.nonzero(to)
            at = np.concatenate([np.arange(len(ids)), row])
            role = np.concatenate([np.zeros(len(ids), np.int8), np.ones(len(row), np.int8)])
            where = np.concatenate([mine, where]).astype(np.int32)
            for i in range(0, len(at), 8192):
                s = pa.array(at[i : i + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(where[i : i + 8192]), pa.array(role[i : i + 8192]), *(b.column(k).take(s) for k in range(3))], ["unit_no", "role", "id", "w", "unit"])

    def meet(batches):
        held: dict = {"unit": None, "rows": [], "tree": None, "guests": [], "n": 0}

        def pack(ids, n, a, b):
            k = np.flatnonzero(n)
            return [
                pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[k], a])), pa.array(np.concatenate([n[k], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.zeros(len(k), np.int64), b]), mask=np.arange(len(k) + len(a)) < len(k))], ["id", "n", "other"])
            ]

        def grow():
            ids, w, x = (np.concatenate([r[i] for r in held["rows"]]) for i in range(3))
            tree = Tree(x)
            held.update(tree=tree, ids=ids, w=w, rows=[])
            found = dual(tree, tree, w, w, cosine, same=True)
            one, two = found.counts()
            held["root"] = local_roots(len(ids), *found.forest())
            # pairs within a node's own range are met by its children, so both counts hold each pair once
            rest = held["root"] != np.arange(len(ids))
            return pack(ids, one + two, ids[rest], ids[held["root"][rest]])

        def visit():
            if not held["guests"]:
                return []
            ids, w, x = (np.concatenate([r[i] for r in held["guests"]]) for i in range(3))
            held.update(guests=[], n=0)
            found = dual(Tree(x), held["tree"], w, held["w"], cosine)
            guests, homes = found.counts()
            none = np.zeros(0, np.int64)
            a, b = found.forest()
            name = np.concatenate([ids, held["ids"][held["root"]]])
            differ = name[a] != name[b]
            return pack(held["ids"], homes, none, none) + pack(ids, guests, name[a][differ], name[b][differ])

        def close():
            out = []
            if held["rows"]:
                out += grow()
            return out + visit()

        for b in batches:
            if not b.num_rows:
                continue
            no, role, ids, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = _matrix(b.column(4), size)
            cut = np.append(np.flatnonzero(np.append(True, (no[1:] != no[:-1]) | (role[1:] != role[:-1]))), len(no))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if no[s] != held["unit"]:
                    yield from close()
                    held.update(unit=no[s], rows=[], guests=[], n=0, tree=None)
                part = (ids[s:e], w[s:e], x[s:e])
                if role[s] == 0:
                    held["rows"].append(part)
                    continue
                if held["rows"]:
                    yield from grow()
                held["guests"].append(part)
                held["n"] += e - s
                if held["n"] >= BATCH:
                    yield from visit()
        yield from close()

    dealt = celled.mapInArrow(deal, "unit_no int, role byte, id long, w long, unit binary")
    spread = dealt.repartition(max(1, min(total, 8 * partitions(classes.sparkSession))), "unit_no").sortWithinPartitions("unit_no", "role")
    return spread.mapInArrow(meet, "id long, n long, other long")


def near_links(rows: DataFrame, cosine: float = 0.9, unit: int = UNIT, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id) for each vector of rows (vec_id, embedding)."""
    all_ = stash(units(rows))
    # a class is named by a number of its own, so that null ids do no harm
    named = all_.where("unit is not null").groupBy("d1", "d2").agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"), F.first("unit").alias("unit"))
    classes = stash(named.select(F.monotonically_increasing_id().alias("id"), "w", "rep", "unit", "d1", "d2", (F.octet_length("unit") / 8).cast("int").alias("size")))
    parts = [
        _links_of_size(classes.where(F.col("size") == s.size).select("id", "w", "unit"), s.n, s.size, cosine, unit, pivots)
        for s in classes.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    ]
    if not parts:
        return all_.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    met = parts[0]
    for p in parts[1:]:
        met = met.union(p)
    met = stash(met)
    counts = met.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    reach = components(met.where("other is not null").select("id", "other"))
    member = classes.join(reach.withColumnRenamed("node", "id").hint("merge"), "id", "left").join(counts.hint("merge"), "id", "left")
    member = stash(member.select("d1", "d2", "w", "rep", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n")))
    known = with_least(member).select("d1", "d2", (F.col("n") + F.col("w") - 1).alias("n_links"), "component_id")
    linked = all_.where("unit is not null").select("vec_id", "d1", "d2").join(known.hint("merge"), ["d1", "d2"]).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return linked.union(all_.where("unit is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_links(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
