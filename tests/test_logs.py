import gzip

import pytest
from pyspark.sql import functions as F

from ferrywake.functions.text import query_shape, redacted
from ferrywake.operators import logs
from ferrywake.operators.legacy import as_json, balanced
from ferrywake.plans.api import LogAnalysis
from ferrywake.sources.lines import read_lines

HEAD = "2023-11-05T06:07:08.910-0330 I "
SLOW = '{"t":{"$date":"2024-06-01T10:15:30.123+00:00"},"s":"I","c":"COMMAND","id":51803,"ctx":"conn12","msg":"Slow query","attr":{"type":"command","ns":"sales.orders","command":{"find":"orders","filter":{"status":"OPEN","amount":{"$gt":100}},"$db":"sales"},"planSummary":"IXSCAN { status: 1 }","durationMillis":742,"cpuNanos":2100000,"reslen":5120,"remote":"10.0.0.8:41712"}}'
FIND = HEAD + 'COMMAND  [conn3] command zoo.pens command: find { find: "pens", filter: {}, $db: "zoo" } planSummary: COLLSCAN reslen:88 325ms'


def parsed(spark, lines):
    raw = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(lines)], "file_index int, line_number long, raw_line string")
    return logs.entries(raw).orderBy("line_number").collect()


# operations of single-line logs with what must come of them
OPERATIONS = [
    ("COMMAND", 'command zoo.pens command: find { find: "pens", filter: { keeper: "Ute", size: { $lt: 9 } } } planSummary: IDHACK reslen:4 31ms', "find", "zoo.pens", 31, "IDHACK", '{"keeper":"?","size":{"$lt":"?"}}'),
    ("COMMAND", 'command zoo.pens command: aggregate { aggregate: "pens", pipeline: [ { $group: { _id: 7 } }, { $limit: 3 } ] } 47ms', "aggregate", "zoo.pens", 47, None, '[{"$group":{"_id":"?"}},{"$limit":"?"}]'),
    ("COMMAND", 'command zoo.feed command: insert { insert: "feed", ordered: true } planSummary: NONE 58ms', "insert", "zoo.feed", 58, "NONE", "{}"),
    ("WRITE", "update zoo.feed command: { q: { day: new Date(3), kg: 2.5 }, multi: true } reslen:1 63ms", "update", "zoo.feed", 63, None, '{"day":"?","kg":"?"}'),
    ("WRITE", "remove zoo.gone command: { q: {} } planSummary: COLLSCAN 70ms", "remove", "zoo.gone", 70, "COLLSCAN", "{}"),
    ("COMMAND", 'command zoo.pens command: getMore { getMore: NumberLong(12) } originatingCommand: { aggregate: "pens", pipeline: [ { $match: { wing: null } } ] } 81ms', "getMore", "zoo.pens", 81, None, '[{"$match":{"wing":"?"}}]'),
    ("COMMAND", 'command zoo.keys command: findAndModify { findAndModify: "keys", remove: true, query: { no: 5 } } planSummary: EOF 94ms', "findAndModify", "zoo.keys", 94, "EOF", '{"no":"?"}'),
    ("COMMAND", 'command zoo.$cmd command: createIndexes { createIndexes: "visits", $db: "park", indexes: [ { key: { day: -1 }, sparse: true } ] } 105ms', "createIndexes", "park.visits", 105, None, '[{"key":{"day":"?"},"sparse":"?"}]'),
]


def test_single_line_operations(spark):
    got = parsed(spark, [f"{HEAD}{c}  [conn3] {m}" for c, m, *_ in OPERATIONS])
    assert [(r.status, r.operation, r.namespace, r.duration_ms, r.plan_summary, r.query_pattern, r.is_slow, r.ts_ms) for r in got] == [("SUCCESS", *x[2:], True, 1699177028910) for x in OPERATIONS]


def test_structured(spark):
    (r,) = parsed(spark, ["﻿" + SLOW])
    assert (r.ts_ms, r.operation, r.namespace, r.duration_ms, r.cpu_nanos, r.response_len, r.remote) == (1717236930123, "find", "sales.orders", 742, 2100000, 5120, "10.0.0.8")
    assert r.query_pattern == '{"amount":{"$gt":"?"},"status":"?"}' and r.message_id == 51803


def test_outcomes(spark):
    def slow(duration):
        return '{"t":{"$date":"2024-06-01T10:15:30Z"},"msg":"slow QUERY","attr":{"durationMillis":' + duration + "}}"

    cases = [
        ("", "SKIPPED", "EMPTY_LINE"), ("\x00 \t", "SKIPPED", "EMPTY_LINE"), ("not a log", "SKIPPED", "NOT_MONGODB_LOG"), ("2025-03-10T14:14:17.729+0800 broken", "FAILED", "INVALID_LEGACY_HEADER"),
        ("2025-99-10T14:14:17.729+0800 I X [a] b", "FAILED", "INVALID_TIMESTAMP"), ("{bad", "FAILED", "INVALID_STRUCTURED_JSON"), ('{"a":1}', "FAILED", "MISSING_TIMESTAMP"), (slow("null"), "PARTIAL", "MISSING_SLOW_QUERY_DURATION"),
        (slow("-1"), "PARTIAL", "INVALID_SLOW_QUERY_DURATION"), (slow("1.5"), "PARTIAL", "INVALID_SLOW_QUERY_DURATION"), (slow('"bad"'), "PARTIAL", "INVALID_SLOW_QUERY_DURATION"), (slow('{"$numberDouble":"NaN"}'), "PARTIAL", "INVALID_SLOW_QUERY_DURATION"),
        (slow('"9223372036854775808"'), "PARTIAL", "INVALID_SLOW_QUERY_DURATION"), (slow("9223372036854775808"), "FAILED", "INVALID_STRUCTURED_JSON"), (slow("0"), "SUCCESS", None), (slow("742.0"), "SUCCESS", None), (slow('"742"'), "SUCCESS", None),
        (slow('{"$numberLong":"742"}'), "SUCCESS", None), (slow('5,"reslen":-1'), "PARTIAL", "INVALID_SLOW_QUERY_METRICS"), (FIND.replace("325ms", "-1ms"), "PARTIAL", "INVALID_SLOW_QUERY_DURATION"), (FIND.replace(" 325ms", ""), "PARTIAL", "MISSING_SLOW_QUERY_DURATION"),
        (FIND.replace(', $db: "zoo" }', ""), "PARTIAL", "LEGACY_COMMAND_PARTIAL"), (FIND.replace("reslen:88", "reslen:x"), "PARTIAL", "INVALID_SLOW_QUERY_METRICS"),
    ]
    got = parsed(spark, [c[0] for c in cases])
    assert [(r.status, r.error_code) for r in got] == [c[1:] for c in cases]
    assert all(r.ts_ms is None for r in got if r.status in ("SKIPPED", "FAILED"))


@pytest.mark.parametrize("note", ["{a: 1}", "[key: 2]", "ObjectId(abc)", "new Date(1)", r"\"escaped\" {a: 1} ObjectId(abc)"])
def test_strings_stay_whole(note):
    document = '{"find": "items", "filter": {"note": "' + note + '"}}'
    assert as_json(document) == document


def test_shell_documents():
    assert as_json('{ a: ObjectId("x)y"), $b.c: [ new Date( 1 ), k: 2 ] }') == '{ "a": "?", "$b.c": [ "?", "k": 2 ] }'
    assert balanced('x command: { a: "}", b: { c: 1 } } tail', "command:") == '{ a: "}", b: { c: 1 } }'
    assert balanced("x command: { a: 1", "command:") is None and balanced("x", "command:") is None


def test_shapes(spark):
    cases = {'{"b":1,"a":[1,null,"x"]}': '{"a":["?","?","?"],"b":"?"}', "null": "{}", "[]": "[]", '{"a":{"$oid":"5"}}': '{"a":"?"}', '{"a":{"$regex":"x"}}': '{"a":{"$regex":"?"}}', '{"a":{"$timestamp":{"t":1,"i":2}}}': '{"a":"?"}', '{"q\\"k":"v\\"{"}': '{"q\\"k":"?"}'}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string")
    assert [r[0] for r in df.select(query_shape(F.col("d"))).collect()] == [*cases.values(), "{}"]


def test_redaction(spark):
    cases = {
        "{'passwd': 'it\\'s here', 'principal': \"svc-7\", 'n': 1}": "{'passwd': [REDACTED], 'principal': [REDACTED], 'n': 1}",
        "secret:abc123, user=ute principal \"The Keeper\" left": "secret:[REDACTED], user=[REDACTED] principal [REDACTED] left",
        "token=" + "q" * 9000 + "; done": "token=[REDACTED]; done",
        "no principal here, no user either": "no principal here, no user either",
        "10.1.2.3 asked fe80::1%eth0 of mongodb+srv://u:p@h.example/x for ute.k@zoo.example.org": "[IP] asked [IP] of [MongoDB URI] for [EMAIL]",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string")
    once = df.select(redacted(F.col("d")).alias("d"))
    assert [r[0] for r in once.collect()] == [*cases.values(), ""]
    assert [r[0] for r in once.select(redacted(F.col("d"))).collect()] == [*cases.values(), ""]


def test_line_numbers_and_gzip(spark, tmp_path):
    plain, packed = tmp_path / "a.log", tmp_path / "b.log.gz"
    plain.write_text("\n".join(f"a{i}" for i in range(5000)) + "\n")
    packed.write_bytes(gzip.compress(b"b0\nb1\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, [str(plain), str(packed)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file_index, r.line_number, r.raw_line) for r in rows) == [(0, i + 1, f"a{i}") for i in range(5000)] + [(1, 1, "b0"), (1, 2, "b1")]
    for bad in ([], ["x.zip"], ["x.BZ2"]):
        with pytest.raises(ValueError):
            read_lines(spark, bad)


def test_analysis_end_to_end(spark, tmp_path):
    plain, packed = tmp_path / "a.log", tmp_path / "b.log.gz"
    extra = [
        '{"t":{"$date":"2024-06-01T10:16:00Z"},"s":"W","c":"REPL","msg":"Heartbeat failed after max retries","attr":{}}',
        '{"t":{"$date":"2024-06-01T10:15:00Z"},"s":"I","c":"NETWORK","msg":"Connection accepted","svc":"R","tags":["x"],"attr":{"connectionCount":8,"remote":"10.0.0.9:1"}}',
        '{"t":{"$date":"2024-06-01T10:17:00Z"},"s":"I","c":"NETWORK","msg":"client metadata","truncated":{},"attr":{"doc":{"application":{"name":"app"},"driver":{"name":"d","version":"1"}}}}',
        '{"t":{"$date":"2024-06-01T10:18:00Z"},"s":"I","c":"COMMAND","msg":"Slow query","attr":{"ns":"a.b","command":{"aggregate":"b","pipeline":[{"$match":{"x":1}}]},"planSummary":"COLLSCAN","durationMillis":100,"docsExamined":1000,"nreturned":10,"keysExamined":{"$numberLong":"5"},"storage":{"data":{"timeReadingMicros":60000}},"locks":{"Global":{"timeAcquiringMicros":{"r":5,"w":7}}},"queues":{"e":{"totalTimeQueuedMicros":3}},"sortSpilledBytes":9,"hasSortStage":true,"usedDisk":"true","queryFramework":"sbe","queryHash":"H"}}',
        "", "junk",
    ]
    plain.write_text("\n".join([SLOW, *extra]) + "\n")
    packed.write_bytes(gzip.compress((FIND + "\n").encode()))
    a = LogAnalysis.from_paths(spark, [str(plain), str(packed)])
    s, d = a.summary(), a.diagnostics()
    assert s["line_counts"].first().asDict() == {"total": 8, "success": 6, "partial": 0, "skipped": 2, "failed": 0}
    assert sorted(r.duration_ms for r in s["slowest"].collect()) == [100, 325, 742]
    assert [r.n for r in s["duration_histogram"].collect()] == [0, 2, 1, 0, 0, 0, 0, 0]
    assert {r.operation for r in s["by_operation"].collect()} == {"find", "aggregate"}
    sig = d["signal_counts"].first().asDict()
    assert {k for k, v in sig.items() if v and k != "slow_total"} == {"collscan", "high_docs_ratio", "storage_dominant", "lock_wait", "queue_wait", "sort_stage", "spilled"} and sig["collscan"] == 2
    assert [(r.kind, r.n) for r in d["replication"].collect()] == [("HEARTBEAT_FAILURE", 1)]
    assert d["abnormal"].count() == 1 and d["out_of_order"].collect()[0].out_of_order == 1
    assert d["quality"].first().asDict() == {"structured": 5, "legacy": 1, "truncated": 1, "tagged": 1}
    assert {(r.kind, r.value) for r in d["frequent_names"].collect()} >= {("application", "app"), ("driver", "d 1"), ("service", "R"), ("query_framework", "sbe")}
    assert d["insights"].first().lock_ms == 0.012
    assert a.slow_queries(1, 2).collect()[0].total == 3 and a.slow_queries(operation="AGG").collect()[0].duration_ms == 100
    assert a.slow_query("0-1").first().namespace == "sales.orders"
    with pytest.raises(KeyError):
        a.slow_query("9-9")
    with pytest.raises(ValueError):
        a.slow_queries(0)
    text = a.report("log | one")
    assert "# log \\| one" in text and "client-1" in text and "10.0.0.8" not in text and "Efficiency signals" in text
    assert "has no diagnostics" in a.report(with_diagnostics=False)
    a.write(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/summary/line_counts")).first().total == 8
