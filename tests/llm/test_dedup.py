import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ferrywake.llm import cover_tree, graph, simhash, suffix_dedup


def closed(n, links):
    """Smallest reachable index of each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(50)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(260)] + [(900, k) for k in range(901, 950)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {x.node: x.root for x in graph.components(df).collect()}
    want = closed(1000, links)
    assert got == {i: c for i, c in enumerate(want) if c != i}
    assert graph.components(df.limit(0)).count() == 0


def bits_of(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_edges():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \t\n ") == 0
    assert simhash.fingerprint(b"One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint("É a b c d".encode()) == bits_of("É a b c d")  # only ASCII letters fold
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(long.encode()) == bits_of(long)


@pytest.mark.parametrize("bucket", [4096, 6])
def test_simhash_against_all_pairs(spark, make, prose, bucket):
    base = [prose(i, 300) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    r = random.Random(2)
    for i in range(120):
        words = base[i % 12].split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "zz"
        rows.append((100 + i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " "), (503, base[0]), (503, base[0]), (None, base[1]), (None, "only one null id of its kind here")]
    got = simhash.near_components(make(rows), bucket=bucket).collect()
    fps = np.array([bits_of(t) for _, t in rows], np.uint64)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    comp = closed(len(rows), near.tolist())
    least = defaultdict(lambda: None)
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = d if least[c] is None else min(least[c], d)
    want = Counter((d, int(np.uint64(f).view(np.int64)), least[c]) for (d, _), f, c in zip(rows, fps, comp))
    assert Counter((x.doc_id, x.fp, x.component_id) for x in got) == want
    kept = simhash.survivors(make(rows))
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({v for v in least.values() if v is not None}) and ids.count(None) == 1
    assert kept.columns == make(rows).columns


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{i}x{seed}"
    return " ".join(words)


@pytest.mark.parametrize("limits", [{}, {"most": 3, "block": 2}])
def test_pipeline_keeps_no_similar_texts(make, prose, limits):
    base = [prose(i, 300) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 10 * i + k, edited(t, 1 + k, 10 * i + k)) for i, t in enumerate(base) for k in range(10)]
    rows += [(400, base[0].upper()), (401, base[0]), (401, base[0]), (None, base[1]), (402, None), (403, ""), (404, "!"), (405, "two words"), (406, "TWO  words"), (None, "no id")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)]
    comp = closed(len(rows), links)
    least = {c: min((d for (d, _), e in zip(rows, comp) if e == c and d is not None), default=None) for c in comp}
    got = simhash.dissimilar(make(rows), **limits)
    ids = [x.doc_id for x in got.collect()]
    assert Counter(ids) == Counter(least[c] for c in set(comp)) and got.columns == make(rows).columns
    assert simhash.dissimilar(make([])).count() == 0
    near = [d for d, _ in simhash.near_components(make(rows)).where("doc_id < 400").select("component_id", "fp").distinct().collect()]
    assert len(set(near)) > len([d for d in ids if d is not None and d < 400])


def test_fingerprints_of_shingle_sets():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.unique(hashes[:n]) for n in (0, 1, 4, 5, 40, 81, 300)]
    got = simhash.signs(sets)
    for x, bits in zip(sets, got):
        for j in (0, 1, 77, 1234, 4095):
            ones = sum((int(h) >> 63 ^ (int(h) & 4095 & j).bit_count() & 1) == 0 for h in x)
            assert bits[j] == (ones * 2 > len(x))
    others = [np.unique(rng.integers(0, 1 << 64, 200, dtype=np.uint64)) for _ in range(40)]
    near = [np.unique(np.append(x[:180], rng.integers(0, 1 << 64, 22, dtype=np.uint64))) for x in others]
    a, b = simhash.signs(others), simhash.signs(near)
    assert (a != b).mean(axis=1).max() < 0.18 and (a[1:] != b[:-1]).mean(axis=1).min() > 0.4
    assert [m is None for m in simhash.marks(sets, 0.8)] == [True, True, False, False, False, False, False]


@pytest.mark.parametrize("n", [40, 700])
def test_close_fingerprints_against_all_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 64, (2, n // 4), dtype=np.uint64)
    seen = base[:, rng.integers(0, n // 4, n)]
    for _ in range(26):
        seen ^= np.uint64(1) << rng.integers(0, 64, (2, n)).astype(np.uint64) * (rng.random((2, n)) < 0.5)
    few = rng.random(n) < 0.3
    d = np.bitwise_count(seen[:, :, None] ^ seen[:, None]).sum(axis=0)
    links = np.argwhere(d <= np.where(few[:, None] | few, simhash.FEW_APART, simhash.APART)).tolist()
    assert simhash.close_roots(seen, few).tolist() == closed(n, links) and n < len(links) < n * n


def test_pipeline_pairs_come_by_fingerprints(make, prose, monkeypatch):
    """Of similar texts that no close fingerprints join, all stay; equal sets of shingles are one class without."""
    base = prose(3, 300)
    rows = [(0, base), (1, edited(base, 1, 1)), (2, base.upper())]
    assert [r.doc_id for r in simhash.dissimilar(make(rows)).collect()] == [0]
    assert [r.doc_id for r in simhash.dissimilar(make(rows), held=1).collect()] == [0]  # whole buckets, unheld
    monkeypatch.setattr(simhash, "_blocks", lambda batches: iter(()))
    assert sorted(r.doc_id for r in simhash.dissimilar(make(rows)).collect()) == [0, 1]


def copies_apart(prose, n):
    """Copies of one text, each edited in other places; and what is left of them, by all pairs."""
    base = prose(5, 150)
    rows = [(i, edited(base, 1 + i % 9, i)) for i in range(n)]
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    comp = closed(n, [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])
    return rows, sorted(set(comp))


def test_copies_edited_apart_meet_in_no_blocks(make, prose, monkeypatch):
    """A group of many components sends each class on once, not once for each block of others."""
    rows, want = copies_apart(prose, 90)
    monkeypatch.setattr(simhash, "_with_others", None)
    assert sorted(r.doc_id for r in simhash.dissimilar(make(rows), block=2).collect()) == want and 10 < len(want) < 80


@pytest.mark.parametrize("limits", [{"hot": 0, "part": 900, "rounds": 1}, {"rounds": 0, "block": 7}, {"hot": 1, "part": 9000, "held": 1}])
def test_groups_left_open_are_compared(make, prose, limits):
    rows, want = copies_apart(prose, 60)
    assert sorted(r.doc_id for r in simhash.dissimilar(make(rows), **limits).collect()) == want


@pytest.mark.parametrize("hot", [64, 2, 0])
def test_meetings_against_all_pairs(hot):
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 64, 90, dtype=np.uint64))
    sets = [np.unique(np.append(rng.choice(base, 90 - m - k, replace=False), rng.integers(0, 1 << 64, m, dtype=np.uint64))) for m in range(24) for k in (0, 2, 9, 15)]
    size, node, label = np.array([len(x) for x in sets]), rng.permutation(len(sets)) + 1000, np.arange(len(sets)) % 7
    ordered = [np.concatenate([x[~np.isin(x, base)], x[np.isin(x, base)]])[: simhash.heads(np.array(len(x)), 0.8)[1]] for x in sets]
    head = [x.tobytes() + np.arange(len(x), dtype=np.int32).tobytes() for x in ordered]
    mark = np.frombuffer(b"".join(m[:164].ljust(168, b"\0") for m in simhash.marks(sets, 0.8)), np.uint64).reshape(len(sets), -1)
    pairs, groups = simhash.meetings(node, label, mark, size, head, 0.8, hot)
    met = {tuple(p) for p in pairs.T.tolist()}
    under = [set(g[1].tolist()) for g in groups]
    like = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if node[i] > node[j] and label[i] != label[j] and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))]
    assert len(like) > 100 and all((node[i], node[j]) in met or any({node[i], node[j]} <= g for g in under) for i, j in like)
    assert (hot < 64) == bool(groups) and all(g[2][0] in g[1] for g in groups)


def test_similar_sets_against_all_pairs():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, 100)) for _ in range(5)]
    sets = [np.unique(np.concatenate([rng.choice(base[k], 100 - m, replace=False), rng.integers(0, 1 << 62, m)])) for k in range(5) for m in rng.integers(0, 30, 16)]
    rng.shuffle(order := np.arange(len(sets)))
    sets = [sets[i] for i in order]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))]
    every, none = np.arange(len(sets)), np.full(len(sets), -1)
    assert sorted((j, i) for i, j in simhash.like_pairs(sets, every, none, 0.8)) == sorted(links) and len(links) > 50
    half, label = every % 2, every % 3
    assert sorted((j, i) for i, j in simhash.like_pairs(sets, label, half, 0.8)) == sorted((i, j) for i, j in links if (i - j) % 2 and (i - j) % 3)


def test_shingle_sets(monkeypatch, prose):
    texts = [prose(i, 40) for i in range(8)] + ["", " ", "one", "One  TWO\tthree four", "one two three four five", "é " * 30, "x" * 500 + " y"]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    whole = simhash.shingle_sets([t.encode() for t in texts], 5)
    for a, x in zip(want, whole):
        assert len(a) == len(x)
        for b, y in zip(want, whole):
            assert len(a & b) == len(np.intersect1d(x, y))
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert all((x == y).all() for x, y in zip(whole, simhash.shingle_sets([t.encode() for t in texts], 5)))


def test_simhash_empty(make):
    assert simhash.near_components(make([])).count() == 0


def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - n + 1):
            if count[x[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(x), int(gone.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


def test_suffix_order_and_prefixes():
    r = random.Random(1)
    for _ in range(30):
        contexts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))).encode() for _ in range(r.randrange(1, 8))]
        for n in (1, 3, 9):
            count = Counter(c[i : i + n] for c in contexts for i in range(len(c) - n + 1))
            want = [[i for i in range(len(c) - n + 1) if count[c[i : i + n]] > 1] for c in contexts]
            assert [x.tolist() for x in suffix_dedup.repeated(contexts, n)] == want


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_suffix_dedup_against_all_windows(spark, make, prose, bucket):
    passage = prose(999, 60)
    rows = [(i, prose(i, 80)) for i in range(15)]
    rows += [(20 + i, prose(50 + i, 30) + passage + prose(80 + i, 30)) for i in range(12)]
    rows += [(40, passage), (41, None), (42, ""), (43, "short"), (44, "ä" * 400), (45, rows[0][1]), (46, rows[1][1].replace("the", "thé", 2)), (47, "x" * 199), (47, "x" * 200), (48, prose(3, 40) * 3)]
    rows += [(None, rows[2][1]), (50, "kept as it is, once " + prose(777, 50)), (50, "kept as it is, once " + prose(777, 50))]
    got = suffix_dedup.dedup(make(rows), bucket=bucket).collect()
    want = Counter((d, *w) for (d, _), w in zip(rows, brute_repeats([t for _, t in rows], 200)))
    assert Counter((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.runs), bytes(x.kept)) for x in got) == want


def test_suffix_dedup_long_and_empty(make, monkeypatch):
    assert suffix_dedup.dedup(make([])).count() == 0
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 1000)
    text = "".join(random.Random(4).choice("abcdefghij") for _ in range(5000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts = [s for i, j, a, e in suffix_dedup._pieces(np.array([5000, 10]), 200) for s in ([(i, j, a, e)])]
    assert starts[0] == (0, 1, 0, 1199) and starts[-1][:2] == (1, 2)
    seen = np.zeros(5000, int)
    for _, _, a, e in starts[:-1]:
        doc, s, n, anchor, h = suffix_dedup.segments(data[a:e], np.array([0]), np.array([e - a]))
        for x, y in zip(s + a, n):
            seen[x : x + y] += 1
    assert (seen[: 5000 - 199] == 1).all() and not seen[5000 - 199 :].any()  # each window in one segment


def test_digest_matches(make, prose):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (3, "a b")]
    got = {x.doc_id: hashlib.sha256(bytes(x.kept)).hexdigest() for x in suffix_dedup.dedup(make(rows)).collect()}
    assert got[3] == hashlib.sha256(b"a b").hexdigest() and got[1] == got[2] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("unit", [16384, 40])
def test_cover_tree_against_all_pairs(spark, unit):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.01, 0.2, 0.4], size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, [2 * v for v in rows[1][1]]), (502, None), (503, []), (504, [0.0] * 16), (505, [float("nan")] + [1.0] * 15), (506, [None] + [1.0] * 15), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [float("inf")] * 16), (None, rows[2][1])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, unit int")
    got = cover_tree.near_links(df, unit=unit).collect()
    full = [None if not v or any(a is None or not np.isfinite(a) for a in v) or not any(v) else np.array(v, np.float32).astype(float) for _, v in rows]
    links = [(i, j) for i, a in enumerate(full) for j, b in enumerate(full) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9]
    comp = closed(len(rows), links)
    least = defaultdict(lambda: None)
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = d if least[c] is None else min(least[c], d)
    n = Counter(i for i, _ in links)
    want = Counter((d, n[i], None if d is None else least[comp[i]]) for i, (d, _) in enumerate(rows))
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == want
    assert cover_tree.near_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [32, 384])
def test_cover_tree_of_nearly_equal_vectors(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(60):
        v = rng.normal(size=size).astype(np.float32)
        u = v.copy()
        u[i % size] = np.nextafter(u[i % size], np.float32(9))
        rows += [(2 * i, v.astype(float).tolist()), (2 * i + 1, (u.astype(float) if i % 2 else 3 * v.astype(float)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    full = np.array([v for _, v in rows])
    full /= np.sqrt((full * full).sum(axis=1))[:, None]
    near = full @ full.T >= 0.9
    assert (near.sum(axis=1) == 2).all()
    got = {x.vec_id: (x.n_links, x.component_id) for x in cover_tree.near_links(df).collect()}
    assert got == {i: (1, i - i % 2) for i, _ in rows}
