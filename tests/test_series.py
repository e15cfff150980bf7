import struct
import zlib

import pytest

from ferrywake.operators import series as S
from ferrywake.plans.api import MetricStore
from ferrywake.sources import capture as C

from .builders import META, block, document, payload, simple, varint


def points(spark, rows, path="m"):
    return spark.createDataFrame([(path, t, v) for t, v in rows], "path string, ts_ms long, value long")


def shown(df):
    return [(r.ts_ms, r.value) for r in df.orderBy("ts_ms").collect()]


def test_flatten_order_and_kinds():
    nested = [("i32", "i32", 7), ("i64", "i64", 8), ("bool", "flag", 1), ("ts", "ts", (5, 6)), ("str", "ignored", "x")]
    doc = document([("date", "start", 1000), ("doc", "nested", nested), ("arr", "array", [("i32", 1), ("f64", 2.9)])])
    paths, values = C.flatten(doc)
    assert paths == ["start", "nested/i32", "nested/i64", "nested/flag", "nested/ts/t", "nested/ts/i", "array/0", "array/1"]
    assert values == [1000, 7, 8, 1, 5, 6, 1, 2]
    columns = [[v, v, v + 1] for v in values]
    names, got = C.decode_block(block(payload(doc, columns)))
    assert names == paths and got.tolist() == columns


def test_wrap_around_and_doubles():
    big = (1 << 63) - 1
    doc = document([("date", "start", 0), ("i64", "x", big)])
    assert C.decode_block(block(payload(doc, [[0, 1], [big, -big - 1]])))[1].tolist() == [[0, 1], [big, -big - 1]]
    assert [C._whole(x) for x in (float("nan"), 1e300, -1e300, -1.9, float("inf"))] == [0, big, -big - 1, -1, big]


def test_broken_blocks():
    doc = document([("date", "start", 0), ("i64", "x", 1)])
    good = payload(doc, [[0, 1], [1, 1]])
    C.decode_block(block(good))
    bad = [
        b"\x10\0\0\0junk", struct.pack("<I", 99) + zlib.compress(good), block(good) + b"x", block(good + b"\x01"), block(payload(doc, [[0, 1], [1, 1]], attributes=3)),
        block(doc + struct.pack("<ii", 2, 1) + varint(1) + varint(0) + varint(5)), block(doc + struct.pack("<ii", 2, 200_000)), block(doc + struct.pack("<ii", 2, 99_999) ), block(doc + struct.pack("<ii", 2, 1) + b"\x80"),
        block(doc + struct.pack("<ii", 2, 1) + b"\xff" * 9 + b"\x7f\x01"), block(payload(document([("i64", "x", 1)]), [[1, 2]])),
    ]
    for b in bad:
        with pytest.raises(C.CaptureError):
            C.decode_block(b)
    for data in (b"", META, b"\x01\0", simple([0], x=[1])[:-3], document([("str", "type", "x")]), document([("i32", "type", 1)])):
        with pytest.raises(C.CaptureError):
            list(C.scan(data))


def test_counter_views(spark):
    m = points(spark, [(0, 10), (1000, 12), (2000, 12), (3000, 9)])
    raw = S.stats(m).first()
    assert (raw.min_value, raw.max_value, raw.avg_value) == (9, 12, 10.75)
    d = S.view(m, S.Query(view="delta", max_points=2))
    r = S.stats(d).first()
    assert (r.min_value, r.max_value) == (-3, 2) and r.avg_value == pytest.approx(-1 / 3)
    assert [v for _, v in shown(S.downsampled(d, S.Query(view="delta", max_points=2)))] == [None, -3]
    assert shown(S.delta(points(spark, [(0, -(1 << 63)), (1, 1)])))[1] == (1, -(1 << 63) + 1)


def test_extremes_survive(spark):
    m = points(spark, [(1000, 10), (2000, 11), (3000, 999), (4000, -500), (5000, 12)])
    assert shown(S.downsampled(m, S.Query(max_points=4))) == [(1000, 10), (3000, 999), (4000, -500), (5000, 12)]
    assert S.stats(m).first().avg_value == 106.4


def test_gaps_are_marked(spark):
    rows = [(t * 1000, v) for t, v in zip([1, 2, 3, 12, 13, 14, 15, 30, 31, 32, 33, 34], [5, 900, 5, 5, 5, 5, 5, 5, -700, 5, 5, 5])]
    m = points(spark, rows)
    assert [(r.from_ms, r.to_ms) for r in S.gaps(m, 100).orderBy("from_ms").collect()] == [(3000, 12000), (15000, 30000)]
    got = shown(S.downsampled(m, S.Query(max_points=6)))
    assert len(got) <= 6 and sum(v is None for _, v in got) == 2 and {900, -700} <= {v for _, v in got}
    whole = shown(S.downsampled(m, S.Query(max_points=100)))
    assert [(4000, None), (16000, None)] == [p for p in whole if p[1] is None] and len(whole) == 14


def test_group_names(spark):
    paths = {"start": None, "serverStatus/network/bytesIn": "network", "systemMetrics/netstat/Tcp:x": "systemMetrics/netstat/Tcp", "systemMetrics/netstat/TcpExt:x": "systemMetrics/netstat/TcpExt", "serverStatus/wiredTiger/cache/pages read": "wiredTiger/cache/pages", "flat": "flat"}
    got = {r.path: r.name for r in S.groups(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {p: n for p, n in paths.items() if n}


def test_store_round_trip(spark, tmp_path):
    (tmp_path / "a").write_bytes(META + simple([1000, 2000, 3000], x=[10, 20, 30], z=[0, 0, 0]) + simple([4000, 5000], y=[1, 2]))
    (tmp_path / "b").write_bytes(simple([2000, 3000, 4000], x=[200, 300, 400]))
    files = [str(tmp_path / "a"), str(tmp_path / "b")]
    store = MetricStore.build(spark, files, str(tmp_path / "store"))
    assert store.catalog()["totals"].first().asDict() == {"blocks": 3, "samples": 8, "start_ms": 1000, "end_ms": 5000}
    assert store.catalog()["schemas"].count() == 3
    assert shown(store.page("x").drop("total")) == [(1000, 10), (2000, 20), (3000, 30), (4000, 400)]
    group = next(r.group_id for r in store.groups().collect() if r.name == "x")
    pts, stats = store.group_series(group, view="delta")
    assert [v for _, v in shown(pts)] == [None, 10, 10, 370] and stats.first().max_value == 370
    with pytest.raises(KeyError):
        store.group_series("none")
    with pytest.raises(ValueError):
        S.Query(max_points=0)
    store.export_csv("x", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert store.changed_sources(files).count() == 0
    (tmp_path / "b").write_bytes(b"changed")
    assert store.changed_sources(files).count() == 1
    assert [r.path for r in S.only_nonzero(S.merged(store.samples())).select("path").distinct().orderBy("path").collect()] == ["start", "x", "y"]
