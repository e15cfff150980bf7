import pytest

from ferrywake.operators import summary as A
from ferrywake.plans import report

SCHEMA = "file_index int, line_number long, ts_ms long, namespace string, operation string, query_pattern string, duration_ms long, cpu_nanos long, response_len long, plan_summary string, remote string, query_id string"


def slow(spark, rows):
    base = dict(file_index=0, ts_ms=0, namespace="db.a", operation="find", query_pattern="{}", duration_ms=1, cpu_nanos=None, response_len=None, plan_summary=None, remote=None)
    full = [base | {"line_number": i} | r for i, r in enumerate(rows)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((r | {"query_id": f"{r['file_index']}-{r['line_number']}"})[n] for n in names) for r in full], SCHEMA)


def test_duration_buckets(spark):
    s = slow(spark, [{"duration_ms": d} for d in (99, 100, 499, 500, 999, 1000, 2999, 3000, 9999, 10000, 29999, 30000, 59999, 60000)])
    rows = A.duration_histogram(s).collect()
    assert [r.n for r in rows] == [1, 2, 2, 2, 2, 2, 2, 1]
    assert (rows[1].total_ms, rows[1].avg_ms, rows[1].max_ms) == (599, 299.5, 499)
    assert [r.n for r in A.duration_histogram(s.limit(0)).collect()] == [0] * 8


def test_cpu_ratios(spark):
    ms = 1_000_000
    rows = [{"duration_ms": 100, "cpu_nanos": int(c * ms)} for c in (0, 0.9, 10, 10.9, 11, 110)] + [{"duration_ms": 100}, {"duration_ms": 0, "cpu_nanos": 5}, {"operation": "remove", "duration_ms": 100, "cpu_nanos": 50 * ms}]
    got = {(r.operation, r.bucket): r.n for r in A.cpu_ratio_histogram(slow(spark, rows)).collect()}
    assert got == {("find", 0): 2, ("find", 10): 2, ("find", 20): 1, ("find", 110): 1, ("delete", 50): 1}


def test_rankings_and_ties(spark):
    rows = [{"namespace": f"db.{i}", "response_len": i} for i in range(21)] + [{"namespace": "db.tie", "response_len": 10}] * 2
    s = slow(spark, rows)
    top = A.by_namespace(s).collect()
    assert len(top) == 20 and [r.namespace for r in top[:2]] == ["db.tie", "db.20"]
    every = A.namespace_bytes(s).collect()
    assert len(every) == 22 and sum(r.response_bytes for r in every) == 230
    tied = slow(spark, [{"duration_ms": 9, "ts_ms": 5}, {"duration_ms": 9, "ts_ms": 4, "file_index": 1}, {"duration_ms": 9, "ts_ms": 4}])
    assert [r.query_id for r in A.slowest(tied).collect()] == ["0-2", "1-1", "0-0"]
    assert A.pattern_stats(tied).first().slowest_query_id == "0-2"
    assert [r.n for r in A.page(A.slowest(tied), 2, 2, *A.ranking()).select("total").toDF("n").collect()] == [3]


def test_report_formats():
    assert [report.decimal(x) for x in (1.0, 0.12345, 2.0005, 1e-9)] == ["1", "0.123", "2.001", "0"]
    assert report.moment(1717236930123) == "2024-06-01T10:15:30.123Z" and report.moment(0) == "1970-01-01T00:00:00Z"
    assert report.cell("a|b\nuser=x") == "a\\|b user=[REDACTED]" and len(report.file_name("ü" * 5 + "x" * 99)) == 80


@pytest.mark.parametrize("size", [0, 201])
def test_page_bounds(spark, size):
    with pytest.raises(ValueError):
        A.page(slow(spark, []), 1, size)
