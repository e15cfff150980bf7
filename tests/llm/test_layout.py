import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ferrywake.llm import lattice, sharding, training_order


def check_shards(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_sharding(spark, make, prose):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(700)] + [(1000 + i, "copy of one text " * 3) for i in range(400)] + [(None, None), (None, None), (5000, ""), (5001, "x" * 30_000), (5002, "é" * 50)]
    got = sharding.shard(make(rows), 8).collect()
    sizes = check_shards(rows, got, 8)
    ideal = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - ideal) for s in sizes.values()) <= 30_016
    assert sorted(abs(s - ideal) for s in sizes.values())[5] < ideal * 0.03
    again = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shard(make(rows).repartition(3), 8).collect() if r.doc_id is not None}
    assert again == {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got if r.doc_id is not None}
    # copies lie next to each other
    places = sorted((r.shard, r.slot) for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1400)
    assert sum(1 for a, b in zip(places, places[1:]) if (b[0], b[1]) not in ((a[0], a[1] + 1), (a[0] + 1, 0))) == 0


def test_sharding_small(make):
    assert sharding.shard(make([]), 40).count() == 0
    check_shards([(1, "a")], sharding.shard(make([(1, "a")]), 40).collect(), 40)
    same = [(7, "same row")] * 30
    assert max(abs(x - 180) for x in check_shards(same, sharding.shard(make(same), 4).collect(), 4).values()) <= 24
    # a third of all bytes in rows that agree in text and (absent) id are parted as any others
    rows = [(None, "one text, again and again")] * 300 + [(i, f"text {i} of its own") for i in range(300)]
    sizes = check_shards(rows, sharding.shard(make(rows), 8).collect(), 8)
    ideal = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(x - ideal) for x in sizes.values()) <= 2 * 41


def test_cells_of_keys():
    key = [np.array(x) for x in ([1, 1, 1, 1, 2, 5, -3, 1], [0, 4, 5, 5, 0, 0, 0, 9], [0, 0, 6, 7, 0, 0, 0, 0])]
    probes = [np.array(x) for x in ([1, 1, 1, 5], [0, 5, 5, 0], [0, 0, 7, 0])]
    want = [sum(p <= k for p in zip(*(x.tolist() for x in probes))) for k in zip(*(x.tolist() for x in key))]
    assert sharding._cells(key, probes).tolist() == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    f = training_order.Feistel(n, 99)
    out = f.slot(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and (f.number(out) == np.arange(n)).all()
    if n > 100:
        assert (training_order.Feistel(n, 98).slot(np.arange(n)) != out).mean() > 0.9


def test_training_order_round_trip(spark, make, prose, tmp_path):
    rows = [(i, prose(i, 3 + i * 7 % 80)) for i in range(60)] + [(100, None), (101, ""), (None, "no id"), (102, "twice"), (102, "twice"), (103, "z" * 5000)]
    kw = dict(key=5, ranks=None, length=64, per_shard=16)
    blobs = training_order.shards(make(rows), **kw).persist()
    kind = training_order.record(64)
    training_order.export(blobs, f"file://{tmp_path}/bin").collect()
    got = list(training_order.read_from(f"{tmp_path}/bin", 0, 64, 16))
    texts, seen = defaultdict(dict), Counter()
    for slot, r in enumerate(got):
        seen[int(r["doc_id"]), int(r["chunk"])] += 1
        texts[int(r["doc_id"])][int(r["chunk"])] = r["ids"][: r["tokens"]]
        assert not r["ids"][r["tokens"] :].any()
    for d, t in rows:
        ids = np.concatenate([texts[training_order.NO_ID if d is None else d][c] for c in sorted(texts[training_order.NO_ID if d is None else d])])
        assert ids[-1] == 256 and bytes(ids[:-1].astype(np.uint8)).decode() == (t or "")
    assert seen[102, 0] == 2 and sum(seen.values()) == sum(-(-(len((t or "").encode()) + 1) // 64) for _, t in rows)
    late = list(training_order.read_from(f"{tmp_path}/bin", 21, 64, 16))
    assert [x.tobytes() for x in late] == [x.tobytes() for x in got[21:]]
    m = training_order.manifest(blobs, 64).orderBy("slot").collect()
    assert [r.slot for r in m] == list(range(len(got))) and [(r.doc_id, r.chunk, r.n_tokens) for r in m] == [(None if x["doc_id"] == training_order.NO_ID else int(x["doc_id"]), int(x["chunk"]), int(x["tokens"])) for x in got]
    assert all(r.n == 16 or r.first_slot + r.n == len(got) for r in blobs.collect()) and kind.itemsize == 16 + 128
    assert training_order.shards(make([]), **kw).count() == 0


def test_training_order_does_not_depend_on_splits(spark, make, prose, tmp_path):
    rows = [(i % 50 if i % 7 else None, prose(i, 3 + i * 7 % 80)) for i in range(400)]
    make(rows).repartition(3).write.option("parquet.block.size", 4096).parquet(f"file://{tmp_path}/docs")
    old, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size, n in (("128MB", None), ("3KB", None), ("20KB", 4)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(f"file://{tmp_path}/docs")
            docs = docs.withColumn("_metadata", docs.doc_id) if n else docs
            got.append({r.first_slot: (r.n, bytes(r.payload)) for r in training_order.shards(docs, key=5, length=64, per_shard=16).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got[0] == got[1] == got[2] and sum(n for n, _ in got[0].values()) > 400


def test_token_ids_of_long_lines():
    enc = training_order.encoder(training_order.RANKS)
    for text in ("the quick brown fox " * 8000, "word\n" * 30_000):
        whole = [i for p in training_order._parts(text) for i in enc(p.encode())[:-1].tolist()]
        assert len(text) > 100_000 and enc(text.encode())[:-1].tolist() == whole
        small = enc(text[: 20_000 - 20_000 % 20].encode())[:-1].tolist()
        assert whole[: len(small) - 5] == small[:-5]


@pytest.mark.parametrize("gap", ["\n", "\t", "  ", "\n    ", "\r\n", "\xa0", "", "-"])
def test_token_ids_of_long_texts_are_those_of_the_tokenizer(gap):
    import base64

    import tiktoken

    with open(training_order.RANKS, "rb") as f:
        pieces = {base64.b64decode(a): int(i) for a, i in (line.split() for line in f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=pieces, special_tokens={})
    r = random.Random(len(gap))
    text = gap.join(r.choice(["the", "hein", "eranenes", "漢字", "don't", "12", "thing,"]) for _ in range(40_000))
    assert len(text) > 100_000 and training_order.encoder(training_order.RANKS)(text.encode())[:-1].tolist() == whole.encode_ordinary(text)


@pytest.fixture(scope="module")
def vocab():
    return lattice.vocabulary()


def segmentations(vocab, unit):
    """All (ids, weight) of a unit, by brute force."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    out = []

    def go(at, ids, w):
        if at == len(unit):
            out.append((tuple(ids), w))
        for end in range(at + 1, len(unit) + 1):
            i = sp.piece_to_id(unit[at:end])
            if i != sp.unk_id() and not sp.is_byte(i) and sp.id_to_piece(i) == unit[at:end]:
                go(end, [*ids, i], w - math.log(2 - sp.get_score(i)))

    go(0, [], 0.0)
    return out


def test_lattices_built_some_units_at_a_time_are_the_same(vocab, prose, monkeypatch):
    units = [lattice.units_of(prose(i, 30) + " " + "x" * (i * 40) + " " + "漢字é" * i) for i in range(12)]
    keys = lattice._mix(np.arange(len(units), dtype=np.uint64) * lattice.BASE)

    def ids():
        lat = lattice.Lattices(vocab)
        return [[(lat.ids(x[0]).tolist(), x[1:]) for x in of_text] for of_text in lattice.sample(lat, keys, units, 2)]

    whole, built, add = ids(), [], lattice.Lattices._add
    monkeypatch.setattr(lattice.Lattices, "_add", lambda self, new: built.append(sum(map(len, new)) if len(new) > 1 else 0) or add(self, new))
    monkeypatch.setattr(lattice, "CHARS", 100)
    small = ids()
    assert len(built) > 10 and 0 < max(built) <= 100
    assert [[x[0] for x in t] for t in small] == [[x[0] for x in t] for t in whole]
    assert np.allclose([x[1] for t in small for x in t], [x[1] for t in whole for x in t])


def test_prefix_tables_find_what_is_there_and_nothing_else(vocab):
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 5000):
        key = np.unique(np.append(r.integers(1, 1 << 63, n, dtype=np.uint64), np.uint64(5)))
        level = lattice.Level(key, np.arange(len(key), dtype=np.int32) - 1)
        h = np.concatenate([key, key + np.uint64(1), r.integers(1, 1 << 63, 3000, dtype=np.uint64)])
        ok, id_ = level.find(h)
        where = {int(x): i - 1 for i, x in enumerate(key)}
        assert ok.tolist() == [int(x) in where for x in h] and id_.tolist() == [where[int(x)] for x in h if int(x) in where]
        assert n < 5000 or len(level.rest) > 100


def test_forgotten_units_change_nothing(vocab, prose):
    units = [lattice.units_of(prose(i % 5, 30) + "".join(f" once{i * 7919 + j}" for j in range(20))) for i in range(60)]
    keys = lattice._mix(np.arange(len(units), dtype=np.uint64) * lattice.BASE)

    def ids(lat):
        out = []
        for i in range(0, 60, 3):
            out += [[lat.ids(x[0]).tolist() for x in t] for t in lattice.sample(lat, keys[i : i + 3], units[i : i + 3], 2)]
        return out

    small, forgot = lattice.Lattices(vocab, 8000), []
    forget, small._forget = small._forget, lambda: forgot.append(small.kept) or forget()
    assert ids(small) == ids(lattice.Lattices(vocab)) and len([x for x in forgot if x]) > 1
    assert ids(lattice.Lattices(vocab, 10)) == ids(lattice.Lattices(vocab))


def test_sampling_is_exact(vocab):
    units = lattice.units_of("on the")
    every = [(a + b, x + y) for (a, x), (b, y) in itertools.product(*(segmentations(vocab, u) for u in units))]
    z = math.log(sum(math.exp(w) for _, w in every))
    p = {ids: math.exp(w - z) for ids, w in every}
    lat, n, k = lattice.Lattices(vocab), 6000, 3
    got = lattice.sample(lat, lattice._mix(np.arange(n, dtype=np.uint64) * lattice.BASE), [units] * n, k)
    first, pairs = Counter(), Counter()
    total = 0.0
    for some in got:
        ids = [tuple(lat.ids(e).tolist()) for e, *_ in some]
        assert len(set(ids)) == k and all(lp == pytest.approx(math.log(p[i])) for i, (_, lp, _, _) in zip(ids, some))
        assert all(a[2] >= b[2] for a, b in zip(some, some[1:])) and all(0 < s[3] <= 1 for s in some)
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
        total += sum(p[i] / s[3] for i, s in zip(ids, some))
    for ids, q in p.items():
        assert abs(first[ids] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
    for (a, b), c in pairs.items():
        q = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - q) < 4 * math.sqrt(q / n) + 1e-3
    assert total / n == pytest.approx(1, abs=0.05)  # inclusion scores are unbiased
    few = lattice.sample(lat, np.array([1], np.uint64), [units], len(every) + 5)[0]
    assert len(few) == len(every) and all(s[3] == 1 for s in few) and sum(math.exp(s[1]) for s in few) == pytest.approx(1)


def test_segment_round_trip(make, prose):
    texts = ["", None, " ", "  two  spaces ", "line\nbreak\ttab", "é 漢字 😀 ﬁ", "a", prose(1, 400), "x" * 3000, "no id", "same", "same"]
    rows = [(i if t != "no id" else None, t) for i, t in enumerate(texts)]
    rows[-1] = (10, "same")
    found = lattice.segment(make(rows), k=3).collect()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    for (d, t) in rows:
        mine = by[d]
        assert {lattice.decode(r.ids) for r in mine} == {t or ""}
        assert len({(tuple(r.ids), r.sample) for r in mine}) == len(mine) // (2 if d == 10 else 1)
        if not t:
            assert [(r.sample, r.ids, r.log_prob, r.inclusion) for r in mine] == [(0, [], 0.0, 1.0)]
    again = {(r.doc_id, r.sample): tuple(r.ids) for r in lattice.segment(make(rows).repartition(5), k=3).collect()}
    assert again == {(r.doc_id, r.sample): tuple(r.ids) for r in found}
    crc = {(r.doc_id, r.sample): r.decoded_crc32 for r in lattice.digests(lattice.segment(make(rows), k=3)).collect()}
    assert all(crc[d, 0] == zlib.crc32((t or "").encode()) for d, t in rows)
    assert lattice.segment(make([])).count() == 0
