"""SentencePiece segmentations: Gumbel top-k without replacement over the lattice of pieces.

A text, with spaces as U+2581 and one before it, is a row of units: each begins with such marks and ends
before the next ones. No piece of the vocabulary spans two units (checked on loading), so the lattice of
a text is the row of its units' lattices. Each distinct unit's lattice is built once in a task: its edges
are the pieces that match, found by rolling hashes along the prefixes of the vocabulary, and bytes where
no piece has a character; a backward pass turns their weights into the probability of each edge given
its node. Weights are the scores of a unigram model, or minus the log of the merge rank for a BPE model.

Segmentations of a text are drawn without replacement by a perturbed A-star search: the best-first queue
holds regions of the tree of segmentations with the maximum of their Gumbel perturbations, which is drawn
top down from the region's probability alone. The region on top yields its best segmentation by walking
the lattice, and what is left of it goes back as two regions: those that leave the same path elsewhere,
and those that share the new branch (steps whose probability is under e^-50 of the region's first are not counted in
its mass). Nothing is expanded that is not emitted. The k + 1st maximum is the
threshold of the inclusion scores: 1 - exp(-exp(log_prob - threshold)).

Randomness is a hash of the seed, the row key, the sample and the place in the text, so results do not
depend on partitions or order.

Defined results: a null or empty text has one segmentation, without pieces, of log probability 0 and
inclusion 1; a text with fewer than k segmentations yields them all, each with inclusion 1; rows with
equal keys and texts get equal results, a null key counts as 0; U+2581 in a text decodes as a space, as
it does in the tokenizer's own decoder.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
SEED = 20260101
MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Edges of known units held in one task, at most, and characters of text segmented at once.
EDGES = 3_000_000
AT_ONCE = 1_200_000
#: Characters of new units whose lattices are built at once; a unit that has more is built whole.
CHARS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
NONE = -(1 << 31)
FULL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Of (0, 1), from hashed numbers."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces with their weights, as sorted hashes of their prefixes by length."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranks = len(plain) > 1 and float(scores[plain].min()) <= -len(plain) / 2  # merge ranks of a BPE model
        weight = -np.log(2.0 + np.maximum(0.0, -scores)) if ranks else scores
        self.bytes_ = np.full(256, -1)
        self.raw: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw.append(b"" if sp.is_control(i) else p.replace(MARK, " ").encode())
        self.weight = weight
        self.floor = float(weight[plain].min()) - 10.0
        pieces = [(sp.id_to_piece(i), i) for i in plain]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces):
            raise ValueError("a piece spans two words")
        self.longest = max(len(p) for p, _ in pieces)
        self.levels = []
        codes = [np.array([ord(c) for c in p], np.uint64) for p, _ in pieces]
        h = np.zeros(len(pieces), np.uint64)
        for k in range(self.longest):
            some = [j for j in range(len(pieces)) if len(codes[j]) > k]
            h[some] = h[some] * BASE + np.array([codes[j][k] for j in some], np.uint64) + np.uint64(1)
            key, first = np.unique(h[some], return_index=True)
            id_ = np.full(len(key), -1, np.int32)
            for j in some:
                if len(codes[j]) == k + 1:
                    id_[np.searchsorted(key, h[j])] = pieces[j][1]
            self.levels.append(Level(key, id_))


class Level:
    """The prefixes of one length in a hash table of one place for each slot; the few that find theirs taken are searched for."""

    def __init__(self, key: np.ndarray, id_: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(key)).bit_length()))
        slot = self._slot(key)
        got, first = np.unique(slot, return_index=True)
        self.key = np.full(1 << (64 - int(self.shift)), FULL, np.uint64)
        self.id = np.full(len(self.key), -1, np.int32)
        self.key[got], self.id[got] = key[first], id_[first]
        rest = np.ones(len(key), bool)
        rest[first] = False
        self.more = np.zeros(len(self.key), bool)
        self.more[slot[rest]] = True
        self.rest, self.rest_id = key[rest], id_[rest]  # in the order of keys, as they came

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * SPREAD >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of prefixes, and the piece of each of these (-1: it is none)."""
        slot = self._slot(h)
        ok, id_ = self.key[slot] == h, self.id[slot]
        late = np.flatnonzero(self.more[slot] & ~ok)
        if len(late):
            i = np.minimum(np.searchsorted(self.rest, h[late]), len(self.rest) - 1)
            hit = self.rest[i] == h[late]
            ok[late[hit]], id_[late[hit]] = True, self.rest_id[i[hit]]
        return ok, id_[ok]


class Lattices:
    """Lattices of known units, those met first for good. All edges of a node stand together, the most probable first, with the probability
    cumulated up to each: a walk takes the first edge that exceeds a uniform number, mostly the first of all."""

    def __init__(self, vocab: Vocabulary, most: int = EDGES):
        self.vocab, self.most = vocab, most
        self.clear()

    def clear(self) -> None:
        self.kept: tuple[int, int, int] | None = None
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.root = np.zeros(0, np.int64)
        self.edge_at = np.zeros(1, np.int64)
        self.cum, self.logp, self.rest = np.zeros(0), np.zeros(0), np.zeros(0)
        self.next, self.node, self.id = (np.zeros(0, np.int32) for _ in range(3))

    def of(self, units, n: int) -> np.ndarray:
        """Root node of each of n units."""
        if len(self.cum) > self.most:
            self._forget()
        known = self.known
        before = len(known)
        ids = np.fromiter(map(known.__getitem__, units), np.int64, n)
        if len(known) > before:
            fresh = list(known)[before:] if before else list(known)
            ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
            a = 0
            while a < len(fresh):  # some units at a time, fewer of long ones; a longer one alone
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHARS, "right"))
                b = max(a + 1, min(b, a + 50_000))
                self._add(fresh[a:b])
                a = b
                if 2 * len(self.cum) <= self.most:
                    self.kept = len(self.root), len(self.edge_at), len(self.cum)
        return self.root[ids]

    def _forget(self) -> None:
        """Forgets all units but those met first, among which the frequent ones are; an edge leads to no other unit's node."""
        if self.kept is None:
            return self.clear()
        units, nodes, edges = self.kept
        self.known = defaultdict(count(units).__next__, islice(self.known.items(), units))
        self.root, self.edge_at = self.root[:units].copy(), self.edge_at[:nodes].copy()
        self.cum, self.logp, self.rest, self.next, self.node, self.id = (x[:edges].copy() for x in (self.cum, self.logp, self.rest, self.next, self.node, self.id))

    def _add(self, units: list[str]) -> None:
        v = self.vocab
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end_of = np.cumsum(size)
        n = len(code)
        left = (np.repeat(end_of, size) - np.arange(n)).astype(np.int32)  # places to the end of the unit
        # nodes by their distance to the end: what an edge leads to has been numbered and weighed before
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        # the pieces that begin at each node, by length
        single, longer = np.full(n, NONE, np.int32), []
        each = np.ones(n, np.int64)
        at, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        for k, level in enumerate(v.levels):
            if k:
                ok = left[at] > k
                at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * BASE + code[at + k] + np.uint64(1)
            ok, i = level.find(h)
            at, h = at[ok], h[ok]
            piece = i >= 0
            from_ = rank[at[piece]]
            if k:
                longer.append((k + 1, from_, i[piece]))
                each[from_] += 1
            else:
                single[from_] = i[piece]
        odd = np.flatnonzero(single[rank] == NONE)  # no piece has the character: its bytes
        c = code[odd].astype(np.int64)
        single[rank[odd]] = np.where(c < 128, v.bytes_[np.minimum(c, 127)], -c - 1)
        # edges by node, then by length
        first = np.append(0, np.cumsum(each))
        node = np.repeat(np.arange(n), each)
        free = first[:-1].copy()
        e_id, e_len = np.empty(first[-1], np.int32), np.ones(first[-1], np.int64)
        e_id[free] = single
        for size_, from_, i in longer:
            free[from_] += 1
            e_id[free[from_]], e_len[free[from_]] = i, size_
        e_w = v.weight[np.maximum(e_id, 0)]
        wide = np.flatnonzero(e_id < 0)
        c = -e_id[wide].astype(np.int64) - 1
        e_w[wide] = v.floor * (2 + (c > 0x7FF) + (c > 0xFFFF))
        to = order[node] + e_len
        to = np.where(e_len == left[order[node]], -1, rank[np.minimum(to, n - 1)])
        beta = np.zeros(len(code) + 1)  # the last one, of -1, is that of the end
        total = e_w.copy()
        steps = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            if a == b:
                continue
            x, y = first[a], first[b]
            val = e_w[x:y] + beta[to[x:y]]
            runs, each = first[a:b] - x, np.diff(first[a : b + 1])
            top = np.maximum.reduceat(val, runs)
            z = top + np.log(np.add.reduceat(np.exp(val - np.repeat(top, each)), runs))
            beta[a:b] = z
            total[x:y] = val - np.repeat(z, each)
        # the most probable edge of a node changes places with its first
        begin = first[:-1]
        best = np.flatnonzero(total == np.repeat(np.maximum.reduceat(total, begin), np.diff(first)))
        best = best[np.append(True, node[best][1:] != node[best][:-1])]
        for x in (total, to, e_id):
            x[begin], x[best] = x[best], x[begin]
        cum = np.cumsum(np.exp(total))
        cum -= np.repeat(np.append(0, cum)[first[:-1]], np.diff(first))
        cum[first[1:] - 1] = 2.0
        nodes, edges = len(self.edge_at) - 1, len(self.cum)
        self.root = np.append(self.root, rank[end_of - size] + nodes)
        self.edge_at = np.append(self.edge_at, first[1:] + edges)
        self.cum = np.append(self.cum, cum)
        self.logp = np.append(self.logp, np.minimum(total, 0.0))
        alone = np.repeat(np.diff(first) == 1, np.diff(first))
        self.rest = np.append(self.rest, np.where(alone, 0.0, np.maximum(0.0, -np.expm1(total))))
        self.next = np.append(self.next, np.where(to >= 0, to + nodes, -1).astype(np.int32))
        self.node = np.append(self.node, (node + nodes).astype(np.int32))
        self.id = np.append(self.id, e_id)

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each node to the end of its unit: edges, and how many of each path."""
        n = len(node)
        who, parts_w, parts_e, step = np.arange(n), [], [], 0
        count = np.zeros(n, np.int64)
        while len(who):
            step += 1
            u = _uniform(_mix(key[who] + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64))))
            e = self.edge_at[node]
            on = np.flatnonzero(self.cum[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.cum[e[on]] <= u[on]]
            parts_w.append(who)
            parts_e.append(e)
            count[who] += 1
            node = self.next[e].astype(np.int64)
            go = node >= 0
            who, node = who[go], node[go]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for s, (w, e) in enumerate(zip(parts_w, parts_e)):
            out[at[w] + s] = e
        return out, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        id_ = self.id[edges]
        odd = np.flatnonzero(id_ < 0)
        if not len(odd):
            return id_
        parts, last = [], 0
        for i in odd.tolist():
            parts += [id_[last:i], self.vocab.bytes_[list(chr(-int(id_[i]) - 1).encode())].astype(np.int32)]
            last = i + 1
        return np.concatenate([*parts, id_[last:]])


class _Text:
    """The search over one text: its samples so far and the queue of regions."""

    __slots__ = ("key", "drawn", "roots", "paths", "regions", "done", "threshold")

    def __init__(self, key: int, roots: np.ndarray):
        self.key, self.roots, self.drawn = key, roots, 0
        self.paths: list[tuple] = []  # edges, place of the unit of each edge, cumulated log probability, perturbed value
        self.regions: list[tuple] = []  # maximum, path, first free step, branches taken, masses of the steps
        self.threshold = -math.inf

    def uniform(self) -> float:
        self.drawn += 1
        x = self.key + self.drawn * 0xA0761D6478BD642F & FULL
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
        x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
        return ((x ^ x >> 31) >> 12 | 0) * 2.0**-52 + 2.0**-53


def _masses(lat: Lattices, t: _Text, path: int, start: int, taken: tuple) -> np.ndarray:
    """Probability of leaving the path at each step from `start` on, but by branches taken, as far as it can count."""
    edges, _, cum, _ = t.paths[path]
    n, width = len(edges), 32
    while start + width < n and cum[start + width] > cum[start] - 50.0:
        width *= 2
    e = edges[start : min(start + width, n)]
    rest = lat.rest[e]
    for s, c in taken:
        if 0 <= s - start < len(rest):
            rest[s - start] = max(0.0, rest[s - start] - math.exp(lat.logp[c]))
            others = lat.edge_at[lat.node[c] + 1] - lat.edge_at[lat.node[c]] - 1 - sum(1 for s2, _ in taken if s2 == s)
            if others <= 0:
                rest[s - start] = 0.0
    return np.exp(cum[start : start + len(e)]) * rest


def _region(lat: Lattices, t: _Text, path: int, start: int, taken: tuple, bound: float) -> None:
    m = _masses(lat, t, path, start, taken)
    mass = float(m.sum())
    if mass > 0:
        value = -math.log(math.exp(-bound) + -math.log(t.uniform()) / mass)
        t.regions.append((min(value, bound), path, start, taken, m))


def _branch(lat: Lattices, t: _Text) -> tuple | None:
    """Takes the region on top and draws where its best segmentation leaves the path."""
    if not t.regions:
        return None
    top = max(range(len(t.regions)), key=lambda i: t.regions[i][0])
    value, path, start, taken, m = t.regions.pop(top)
    step = start + min(int(np.searchsorted(np.cumsum(m), t.uniform() * m.sum(), "right")), int(np.flatnonzero(m)[-1]))
    edge = int(t.paths[path][0][step])
    node = lat.node[edge]
    sides = [c for c in range(int(lat.edge_at[node]), int(lat.edge_at[node + 1])) if c != edge and (step, c) not in taken]
    p = np.exp(lat.logp[sides])
    side = sides[min(int(np.searchsorted(np.cumsum(p), t.uniform() * p.sum(), "right")), len(sides) - 1)]
    _region(lat, t, path, start, taken + ((step, side),), value)
    return value, path, step, side


def sample(lat: Lattices, keys: np.ndarray, texts: list[list[str]], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, given by its units: up to k of (edges, log probability, perturbed value, inclusion)."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.append(0, np.cumsum(n))
    roots = lat.of(chain.from_iterable(texts), int(at[-1]))
    place = np.arange(at[-1]) - np.repeat(at[:-1], n)
    all_ = [_Text(int(key), roots[a:b]) for key, a, b in zip(keys.tolist(), at[:-1], at[1:])]
    live = [i for i in range(len(texts)) if n[i]]

    def unit_keys(key: np.ndarray, place: np.ndarray, turn: int) -> np.ndarray:
        return _mix(key + place.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(turn * 0x2545F4914F6CDD1D % (1 << 64)))

    def keep(t: _Text, edges: np.ndarray, units: np.ndarray, value: float, start: int) -> None:
        cum = np.append(0.0, np.cumsum(lat.logp[edges]))
        t.paths.append((edges, units, cum, value))
        _region(lat, t, len(t.paths) - 1, start, (), value)

    edges, count = lat.walk(roots, unit_keys(np.repeat(keys, n), place, 0))
    ends = np.append(0, np.cumsum(count))
    for i in live:
        t = all_[i]
        a, b = at[i], at[i + 1]
        value = -math.log(-math.log(t.uniform()))
        keep(t, edges[ends[a] : ends[b]], np.repeat(np.arange(b - a), count[a:b]), value, 0)
    for turn in range(1, k):
        cuts = [(i, c) for i in live if (c := _branch(lat, all_[i]))]
        nodes, ukeys, sizes = [], [], []
        for i, (_, path, step, side) in cuts:
            t = all_[i]
            j = int(t.paths[path][1][step])
            after = int(lat.next[side])
            x = t.roots[j + 1 :]
            places = np.arange(j + 1, n[i])
            if after >= 0:
                x, places = np.append(after, x), np.append(j, places)
            nodes.append(x)
            ukeys.append(unit_keys(np.full(len(x), t.key, np.uint64), places, turn))
            sizes.append(len(x))
        if not cuts:
            break
        edges, count = lat.walk(np.concatenate(nodes), np.concatenate(ukeys))
        ends = np.append(0, np.cumsum(count))
        a = 0
        for (i, (value, path, step, side)), size in zip(cuts, sizes):
            t = all_[i]
            b = a + size
            old, units, _, _ = t.paths[path]
            j = int(units[step])
            first = j if int(lat.next[side]) >= 0 else j + 1
            new = np.concatenate([old[:step], [side], edges[ends[a] : ends[b]]])
            keep(t, new, np.concatenate([units[:step], [j], np.repeat(np.arange(first, first + size), count[a:b])]), value, step + 1)
            a = b
    out = []
    for t in all_:
        bound = max((r[0] for r in t.regions), default=-math.inf)
        if not t.paths:
            out.append([(np.zeros(0, np.int64), 0.0, -math.log(-math.log(t.uniform())), 1.0)])
            continue
        some = []
        for edges_, _, cum, value in t.paths:
            lp = float(cum[-1])
            some.append((edges_, lp, value, 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(50.0, lp - bound)))))
        out.append(some)
    return out


def units_of(text: str | None) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


_vocabs: dict[str, Vocabulary] = {}


def vocabulary(path: str = MODEL) -> Vocabulary:
    if path not in _vocabs:
        _vocabs[path] = Vocabulary(path)
    return _vocabs[path]


def decode(ids, path: str = MODEL) -> str:
    raw = vocabulary(path).raw
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def segment(docs: DataFrame, k: int = K, seed: int = SEED, path: str = MODEL, edges: int = EDGES, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, sample, ids, log_prob, perturbed, inclusion, decoded_crc32): up to k distinct segmentations of each text, by
    falling perturbed value; the last column is the CRC of the text that the ids decode to. edges, at_once: what a task
    holds, no matter for the result."""

    def work(batches):
        lat = Lattices(vocabulary(path), edges)
        raw = lat.vocab.raw
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        for b in slices(batches, 2048):
            docs_, texts = b.column(0).to_pylist(), b.column(1)
            sizes = pc.coalesce(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(docs_):
                j, size = i + 1, int(sizes[i])
                while j < len(docs_) and size + sizes[j] <= at_once:
                    size += int(sizes[j])
                    j += 1
                keys = _mix(np.array([(d or 0) & FULL for d in docs_[i:j]], np.uint64) * BASE + np.uint64(seed))
                rows = []
                for d, some in zip(docs_[i:j], sample(lat, keys, [units_of(t) for t in texts[i:j].to_pylist()], k)):
                    for s, (e, lp, g, q) in enumerate(some):
                        ids = lat.ids(e)
                        text = b"".join(map(raw.__getitem__, ids.tolist()))
                        rows.append((d, s, ids, lp, g, q, zlib.crc32(text[1:] if text[:1] == b" " else text)))
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r[2]) for r in rows])), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]), pa.int32()))
                yield pa.RecordBatch.from_arrays([flat if c == 2 else pa.array([r[c] for r in rows], kinds[c]) for c in range(7)], ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded_crc32"])
                i = j

    return only(docs, "doc_id", "text").mapInArrow(work, "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, decoded_crc32 long")


def digests(found: DataFrame) -> DataFrame:
    """found (of segment) with the ids as their number and the XXH64 hash of them all."""
    return found.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "decoded_crc32", "log_prob", "perturbed", "inclusion")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(segment(table(spark, sf_dir, "documents")))
