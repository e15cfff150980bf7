"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from ferrywake.plans.catalog import SQL, Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("events", "documents"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = Q[name](spark, DIR)
    r = con.sql(SQL[name])
    cols = sorted(r.columns)
    assert cols == sorted(df.columns)

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    mine = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    theirs = sorted((tuple(plain(x[r.columns.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert mine == theirs


def test_streaming_windows(spark, tmp_path):
    from ferrywake.streaming import live

    (tmp_path / "in").mkdir()
    lines = ['{"t":{"$date":"2024-06-01T10:%02d:00Z"},"s":"I","msg":"Slow query","attr":{"ns":"a.b","durationMillis":%d}}' % (i, i) for i in range(60)]
    (tmp_path / "in/x.log").write_text("\n".join(lines) + '\n{"t":{"$date":"2024-06-01T13:00:00Z"},"msg":"Slow query","attr":{"ns":"a.b","durationMillis":1}}\n')
    q = live.slow_by_window(live.read(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("live_windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
        rows = spark.sql("SELECT namespace, n, total_ms, max_ms FROM live_windows").collect()
    finally:
        q.stop()
    assert [tuple(r) for r in rows] == [("a.b", 60, 1770, 59)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_captures_of_all_paths_and_negative_values(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    signed = events.withColumn("value", events["value"] * (1 - 2 * (events["event_id"] % 2)))
    signed.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.sql(SQL["o04_capture_round_trip"]).fetchall(), key=repr)
    got = sorted((tuple(r) for r in Q["o04_capture_round_trip"](spark, str(tmp_path)).collect()), key=repr)
    assert got == want and len({r[1] for r in got}) > 5 and {r[0] for r in got} == {0, 1, 2} and min(r[3] for r in got) < -1
