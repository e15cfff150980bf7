"""Queries of sources, parsers and stores: lines and captures are written from the tables, read back and questioned."""

from __future__ import annotations

import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REDACTIONS
from ..functions.values import exact_long
from ..operators import diagnostics as D
from ..operators import legacy, logs
from ..operators import series as S
from ..operators import summary as A
from ..session import shared_folder
from ..sources import capture, lines
from ..sources.store import publish
from . import tasks
from .api import LogAnalysis, MetricStore, written
from .canonical import duck, frame
from .catalog import _CASES, _JSON, _SHELL, _abn, _down, _iso, _keep, _top, Q, SQL, STAT, add, stat_by, unknown


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ferrywake-sources/{uuid.uuid4().hex}"


def on_events(name: str, plan, sql: str) -> None:
    Q[name] = lambda spark, sf_dir: plan(_events(spark, sf_dir))
    SQL[name] = sql


def _written_lines(spark: SparkSession, rows: DataFrame, gzip: tuple[int, ...] = ()) -> list[str]:
    """rows (file, place, value) as text files 0 to 2, each in the order of its places."""
    folder = _folder(spark)
    for i in range(3):
        mine = rows.where(F.col("file") == i).repartition(1).sortWithinPartitions("place").select("value")
        mine.write.option("compression", "gzip" if i in gzip else "none").text(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(3)]


# lines
_LINE = "CASE WHEN event_id % 13 = 0 THEN '' ELSE CONCAT('line ', CAST(event_id AS VARCHAR(20)), ' é | ', COALESCE(event_type, '-')) END"
_LINES = f"SELECT CAST((event_id + 1) % 3 AS INT) AS file_index, ROW_NUMBER() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line_number, {_LINE} AS raw_line FROM events"


def _scanned(gzip: tuple[int, ...]):
    def plan(e: DataFrame) -> DataFrame:
        a, b, c = _written_lines(e.sparkSession, e.selectExpr("event_id % 3 AS file", "event_id AS place", f"{_LINE} AS value"), gzip)
        return lines.read_lines(e.sparkSession, [c, a, b])  # numbered in the order given

    return plan


on_events("o01_line_scan", _scanned(()), _LINES)
on_events("o02_gzip_scan", _scanned((0, 1, 2)), _LINES)
_NAME = "CASE event_id % 8 WHEN 0 THEN 'a.log' WHEN 1 THEN 'b.LOG.GZ' WHEN 2 THEN 'c.zip' WHEN 3 THEN 'd.ZIP' WHEN 4 THEN 'e.bz2' WHEN 5 THEN 'f.log.Xz' WHEN 6 THEN 'g.7z' ELSE 'h.zip.log' END"
on_events("o03_refused_files", lambda e: e.selectExpr("event_id", f"{_NAME} AS name").select("event_id", "name", lines.refused(F.col("name")).alias("refused")), f"SELECT event_id, {_NAME} AS name, event_id % 8 BETWEEN 2 AND 6 AS refused FROM events")


def _of_files(e: DataFrame) -> DataFrame:
    paths = _written_lines(e.sparkSession, e.selectExpr("event_id % 3 AS file", "event_id AS place", f"{_CASES} AS value"), (1,))
    return logs.entries(lines.read_lines(e.sparkSession, paths)).groupBy("file_index", "status").agg(F.count("*").alias("n"))


on_events("o98_union_of_files", _of_files, "SELECT CAST(event_id % 3 AS INT) AS file_index, CASE WHEN event_id % 9 < 3 THEN 'SKIPPED' WHEN event_id % 9 = 8 THEN 'PARTIAL' ELSE 'FAILED' END AS status, COUNT(*) AS n FROM events GROUP BY 1, 2")
_MARKED = "CASE event_id % 6 WHEN 0 THEN '{\"a\":1}' WHEN 1 THEN '﻿{\"a\":1}' WHEN 2 THEN '  {' WHEN 3 THEN 'text {' WHEN 4 THEN '﻿﻿{' ELSE '' END"
on_events("o19_format_routing", lambda e: e.selectExpr("event_id", f"{_MARKED} AS raw").select("event_id", logs.is_structured(F.col("raw")).alias("structured")), "SELECT event_id, event_id % 6 < 3 AS structured FROM events")


# parsers
def parsed(name: str, line: str, columns: list[str], sql: str) -> None:
    """A query over lines made of the entries table. line: SQL of a line; columns: of the entries that come of it."""
    add(name, "entries", lambda e: logs.entries(e.selectExpr("file_index", "line_number", f"{line} AS raw_line")).select("file_index", "line_number", *columns), f"SELECT file_index, line_number, {sql} FROM entries")


def _cases(modulus: int, *values: str) -> str:
    return f"CASE line_number % {modulus} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_ISO = _iso("ts_ms", "yyyy-MM-dd''T''HH:mm:ss.SSS")
parsed(
    "o21_timestamps",
    _cases(7, *[f"CONCAT('{a}', {v}, '{b}')" for a, v, b in (
        ('{"t":{"$date":"', _ISO, 'Z"}}'), ('{"t":{"$date":"', _ISO, '+02:00"}}'), ('{"t":{"$date":', "ts_ms", "}}"), ('{"t":{"$date":{"$numberLong":"', "ts_ms", '"}}}'), ('{"t":"', _ISO, 'Z"}'), ('{"t":', "ts_ms", "}"), ('{"t":{"$date":"', "'nope'", '"}}'),
    )]),
    ["ts_ms", "status", "error_code"],
    "CASE line_number % 7 WHEN 1 THEN ts_ms - 7200000 WHEN 6 THEN NULL ELSE ts_ms END AS ts_ms, CASE WHEN line_number % 7 = 6 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN line_number % 7 = 6 THEN 'MISSING_TIMESTAMP' END AS error_code",
)


def _doc(attr: str, msg: str = "x") -> str:
    """SQL of a structured line; U in attr stands for a number of the user."""
    a, *rest = f'{{"t":{{"$date":5}},"msg":"{msg}","attr":{{{attr}}}}}'.split("U#")
    return "CONCAT('" + a + "'" + "".join(f", CAST(user_id % 9 AS VARCHAR(20)), '{x}'" for x in rest) + ")"


parsed(
    "o23_operations", _cases(5, *[_doc(x) for x in ('"type":"t","command":{"find":"c"}', '"type":"update","command":{"foo":1}', '"type":" "', '"command":{"createUser":"U#"}', '"command":{"zz":1,"find":1}')]), ["operation"],
    "CASE line_number % 5 WHEN 0 THEN 'find' WHEN 1 THEN 'update' WHEN 3 THEN 'createUser' ELSE 'command' END AS operation",
)


def _single(rest: str, stamp: str = "+0000") -> str:
    """SQL of a single-line entry; U# stands for a number of the user."""
    a, *more = f"{stamp} I {rest}".split("U#")
    return f"CONCAT({_ISO}, '{a}'" + "".join(f", CAST(user_id % 9 AS VARCHAR(20)), '{x}'" for x in more) + ")"


parsed(
    "o25_slow_predicate",
    _cases(7, _doc('"durationMillis":1', "Slow query"), _doc("", "SLOW QUERY"), _doc("", "slow query "), _single("COMMAND  [c] command db.c command: find { find: \"c\" } 5ms"), _single("WRITE    [c] remove db.c command: { q: {} } 5ms"), _single("NETWORK  [c] end connection h:1 (2 connections now open)"), _single("COMMAND  [c] command db.c command: count { count: \"c\" } 5ms")),
    ["is_slow"], "line_number % 7 IN (0, 1, 3, 4) AS is_slow",
)
_p = '{"pU#":1}'
parsed(
    "o26_pattern_sources",
    _cases(8, *[_doc(x) for x in (
        f'"command":{{"find":"c","filter":{_p}}}', f'"command":{{"aggregate":"c","pipeline":[{{"$match":{_p}}}]}}', f'"command":{{"update":"c","updates":[{{"q":{_p},"u":{{}}}},{{"q":{{"b":2}}}}]}}', f'"command":{{"delete":"c","deletes":[{{"q":{_p},"limit":0}}]}}',
        f'"command":{{"findAndModify":"c","query":{_p}}}', f'"command":{{"getMore":5}},"originatingCommand":{{"pipeline":[{_p}]}}', f'"command":{{"createIndexes":"c","indexes":[{{"key":{_p}}}]}}', f'"command":{{"insert":"c","q":{_p}}}',
    )]),
    ["query_pattern"],
    "REPLACE(CASE line_number % 8 WHEN 1 THEN '[{\"$match\":{P}}]' WHEN 2 THEN '[{P},{\"b\":\"?\"}]' WHEN 3 THEN '[{\"limit\":\"?\",\"q\":{P}}]' WHEN 5 THEN '[{P}]' WHEN 6 THEN '[{\"key\":{P}}]' ELSE '{P}' END, '{P}', CONCAT('{\"p', user_id % 9, '\":\"?\"}')) AS query_pattern",
)
_stamps = [_single("X [c] m", z) for z in ("+0000", "+0200", "Z", "+02:00")] + ["CONCAT(SUBSTR(" + _ISO + ", 1, 19), '+0000 I X [c] m')"]
parsed("o29_single_line_timestamps", _cases(5, *_stamps), ["ts_ms", "error_code"], "CASE line_number % 5 WHEN 0 THEN ts_ms WHEN 1 THEN ts_ms - 7200000 WHEN 2 THEN ts_ms END AS ts_ms, CASE WHEN line_number % 5 > 2 THEN 'INVALID_TIMESTAMP' END AS error_code")
parsed(
    "o30_single_line_fields",
    _cases(5, _single("WRITE    [c] update db.cU# command: { q: { a: 1 } } planSummary: IXSCAN reslen:12 5ms"), _single("WRITE    [c] remove db.cU# command: { q: { a: 1 } } planSummary: COLLSCAN 7ms"), _single("COMMAND  [c] command db.cU# command: getMore { getMore: 5 } originatingCommand: { filter: { a: 1 } } reslen:3 9ms"),
           _single("NETWORK  [c] connection accepted from 10.0.0.U#:99 #1 (2 connections now open)"), _single("STORAGE  [c] text 3ms")),
    ["operation", "namespace", "duration_ms", "plan_summary", "response_len", "remote", "query_pattern"],
    """CASE line_number % 5 WHEN 0 THEN 'update' WHEN 1 THEN 'remove' WHEN 2 THEN 'getMore' WHEN 3 THEN 'network' ELSE 'storage' END AS operation, CASE WHEN line_number % 5 < 3 THEN CONCAT('db.c', user_id % 9) END AS namespace,
    CASE line_number % 5 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 9 WHEN 4 THEN 3 END AS duration_ms, CASE line_number % 5 WHEN 0 THEN 'IXSCAN' WHEN 1 THEN 'COLLSCAN' END AS plan_summary, CASE line_number % 5 WHEN 0 THEN 12 WHEN 2 THEN 3 END AS response_len,
    CASE WHEN line_number % 5 = 3 THEN CONCAT('10.0.0.', user_id % 9) END AS remote, CASE WHEN line_number % 5 < 3 THEN '{"a":"?"}' ELSE '{}' END AS query_pattern""",
)
_BRACED = "CASE event_id % 5 WHEN 0 THEN CONCAT('x at: { a: \"}{\", b: { c: ', event_id, ' } } tail }') WHEN 1 THEN 'at: { open { a }' WHEN 2 THEN 'nothing { a }' WHEN 3 THEN CONCAT('at: [ { k: \"', event_id, '\" } ]') ELSE 'at: none' END"
on_events(
    "o31_balanced_documents", lambda e: e.selectExpr("event_id", f"{_BRACED} AS x").select("event_id", legacy.balanced_after(F.col("x"), "at:").alias("document")),
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CONCAT('{ a: \"}{\", b: { c: ', event_id, ' } }') WHEN 3 THEN CONCAT('{ k: \"', event_id, '\" }') END AS document FROM events",
)
_SHELLED = "CASE event_id % 4 WHEN 0 THEN CONCAT('{ a: ', event_id, ', $b.c: [ 1, \"x: y\" ] }') WHEN 1 THEN '{ t: new Date(5), i: ObjectId(\"a)b\") }' WHEN 2 THEN '{ \"q\": NumberLong(7), r: { s: true } }' ELSE NULL END"
on_events(
    "o32_shell_documents", lambda e: e.selectExpr("event_id", f"{_SHELLED} AS x").select("event_id", legacy.shell_as_json(F.col("x")).alias("json")),
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CONCAT('{ \"a\": ', event_id, ', \"$b.c\": [ 1, \"x: y\" ] }') WHEN 1 THEN '{ \"t\": \"?\", \"i\": \"?\" }' WHEN 2 THEN '{ \"q\": \"?\", \"r\": { \"s\": true } }' END AS json FROM events",
)
parsed("o33_created_namespaces", _single('COMMAND  [c] command db.$cmd command: createIndexes { createIndexes: "cU#", indexes: [ { key: { a: 1 } } ], $db: "dU#" } 5ms'), ["operation", "namespace", "query_pattern"], "'createIndexes' AS operation, CONCAT('d', user_id % 9, '.c', user_id % 9) AS namespace, '[{\"key\":{\"a\":\"?\"}}]' AS query_pattern")
parsed("o35_heartbeats", _cases(4, _doc("", "Heartbeat failed after U# tries"), _doc("", "heartbeat failed"), _single("REPL     [c] Heartbeat failed"), _single("REPL     [c] a Heartbeat")), ["heartbeat_failure"], "line_number % 4 IN (0, 2) AS heartbeat_failure")
add(
    "o115_line_metadata", "entries", lambda e: logs.line_metadata(e.selectExpr("file_index", "line_number", f"CASE WHEN line_number % 2 = 0 THEN {_JSON.rsplit(' AS ', 1)[0]} ELSE {_SHELL.rsplit(' AS ', 1)[0]} END AS raw_line")),
    """SELECT file_index, line_number, CASE WHEN line_number % 2 = 0 THEN COALESCE(message_id, 7) END AS message_id, CONCAT('conn', user_id) AS context, CASE WHEN line_number % 2 = 0 THEN COALESCE(component, '-') ELSE 'COMMAND' END AS component,
    CAST(NULL AS VARCHAR) AS service, CASE WHEN line_number % 2 = 0 THEN '' END AS tags FROM entries""",
)
_LONG = "CASE event_id % 7 WHEN 0 THEN CONCAT(event_id, '.0000000001') WHEN 1 THEN CONCAT('{\"$numberDecimal\":\"', event_id, '.00000000001\"}') WHEN 2 THEN CONCAT('{\"$numberDecimal\":\"', event_id, '.000\"}') WHEN 3 THEN CONCAT('{\"$numberDecimal\":\"', event_id, '.5E1\"}') WHEN 4 THEN CONCAT('{\"$numberDouble\":\"', event_id, 'E2\"}') WHEN 5 THEN '{\"$numberDecimal\":\"9223372036854775808\"}' ELSE '9223372036854775807' END"
on_events(
    "o22_exact_numbers", lambda e: e.selectExpr("event_id", f"parse_json({_LONG}) AS v").select("event_id", exact_long(F.col("v")).alias("exact")),
    "SELECT event_id, CASE event_id % 7 WHEN 2 THEN event_id WHEN 3 THEN event_id * 10 + 5 WHEN 4 THEN event_id * 100 WHEN 6 THEN 9223372036854775807 END AS exact FROM events",
)


def _in_duckdb(text: str) -> str:
    """The redactions for a dialect without look-around: what stands at either side is matched and put back, twice as matches may share it."""
    out = f"COALESCE({text}, '')"
    for pattern, to in REDACTIONS:
        pattern, to = pattern.replace("*+", "*"), to.replace("$1", "\\1")
        times = 1
        if "(?<!" in pattern:
            head, tail = "(?<![0-9a-f:])", "(?![0-9a-f:])"
            pattern, to, times = pattern.replace(head, "(^|[^0-9a-f:])").replace(tail, "($|[^0-9a-f:])"), f"\\1{to}\\2", 2
        for _ in range(times):
            out = f"REGEXP_REPLACE({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return out


SQL["o37_redacted_documents"] = f"SELECT doc_id, {_in_duckdb('text')} AS text FROM documents"
add("o96_event_order", "entries", lambda e: D.event_list(D.abnormal(e)).select("key", "n", "place"), f", {_abn} SELECT key, n, ROW_NUMBER() OVER (ORDER BY n DESC, key) AS place FROM g")

add("o100_paths_except", "samples", S.kept_paths, "SELECT path FROM samples EXCEPT SELECT p FROM (VALUES " + ", ".join(f"('{p}')" for p in S.EXCLUDED) + ") v(p)")

# tasks
_TASK = "event_id AS task_id, event_id * 7 % 1000 AS done_bytes, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1000 - event_id % 3 END AS total_bytes, event_id % 5 = 0 AS completed"
Q["o97_task_listing"] = lambda spark, sf_dir: tasks.listing(frame(spark, sf_dir, "entries").select(F.col("line_number").alias("task_id"), F.col("ts_ms").alias("created_ms"), "status"))
SQL["o97_task_listing"] = duck("entries") + "SELECT line_number AS task_id, ts_ms AS created_ms, status FROM entries ORDER BY created_ms DESC, task_id"
on_events(
    "o116_progress", lambda e: e.selectExpr(*_TASK.split(", ", 2)[:2], "CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1000 - event_id % 3 END AS total_bytes", "event_id % 5 = 0 AS completed").select("task_id", tasks.progress(F.col("done_bytes"), F.col("total_bytes"), F.col("completed")).alias("percent")),
    f"SELECT task_id, CASE WHEN completed THEN CAST(100 AS DOUBLE) WHEN total_bytes > 0 THEN LEAST(CAST('99.9' AS DOUBLE), CAST(done_bytes AS DOUBLE) * 100 / CAST(total_bytes AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS percent FROM (SELECT {_TASK} FROM events) t",
)


# captures: blocks that are sound or broken in one way each
def _payload(i: int, attributes: int = 2, deltas: int = 1, names: tuple[str, str] = ("start", "a"), tail: bytes | None = None) -> bytes:
    base = capture.document([(9 if n == "start" else 18, n, struct.pack("<q", v)) for n, v in zip(names, (i, 5))])
    return base + struct.pack("<ii", attributes, deltas) + (capture._varint(1000) + capture._varint(i + 1) if tail is None else tail)


def _packed(payload: bytes, declared: int | None = None) -> bytes:
    return struct.pack("<I", len(payload) if declared is None else declared) + zlib.compress(payload)


_BROKEN = {
    "o05_inflated_blocks": (
        lambda i: [_packed(_payload(i)), _packed(_payload(i), 4), _packed(_payload(i), len(_payload(i)) + 1), struct.pack("<I", 50) + b"not deflated", _packed(_payload(i)) + b"x"][i % 5],
        ["declared length 4 out of bounds", "length of the inflated block differs, or bytes trail it", "block does not inflate", "length of the inflated block differs, or bytes trail it"],
    ),
    "o06_decoded_blocks": (
        lambda i: [_packed(_payload(i)), _packed(_payload(i, 3)), _packed(_payload(i, names=("begin", "a"))), _packed(_payload(i, deltas=-1)), _packed(_payload(i)[:12])][i % 5],
        ["3 attributes declared, 2 found", "no start", "2 attributes by -1 deltas are out of bounds", "payload cut short"],
    ),
    "o07_varints": (
        lambda i: [_packed(_payload(i, tail=t)) for t in (None, b"\x05\x80", b"\xff" * 9 + b"\x02" + b"\x01", b"\x01\x02\x03", b"\x01")][i % 5],
        ["varint cut short", "varint overflows", "bytes trail the deltas", "deltas cut short"],
    ),
}


def _checked(make):
    def plan(e: DataFrame) -> DataFrame:
        def build(batches):
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["event_id"], "block": [make(int(i)) for i in pdf["event_id"]]})

        return capture.checked(e.select(F.col("event_id").cast("long").alias("event_id")).mapInPandas(build, "id long, block binary"))

    return plan


for _name, (_make, _errors) in _BROKEN.items():
    _of = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_errors, 1))
    on_events(_name, _checked(_make), f"SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 2 END AS attributes, CASE WHEN event_id % 5 = 0 THEN 2 END AS points, CASE WHEN event_id % 5 = 0 THEN event_id * 3 + 1011 END AS total, CASE event_id % 5 {_of} END AS error FROM events")


def _flattened(e: DataFrame) -> DataFrame:
    def build(batches):
        for pdf in batches:
            out = []
            for i in map(int, pdf["event_id"]):
                items = capture.document([(1, "0", struct.pack("<d", i + 0.75)), (8, "1", bytes([i % 2]))])
                inner = capture.document([(18, "c", struct.pack("<q", i * 10**10)), (4, "d", items)])
                out.append(capture.document([(16, "a", struct.pack("<i", i)), (3, "b", inner), (2, "s", struct.pack("<i", 2) + b"x\0"), (17, "t", struct.pack("<II", 3, i)), (9, "z", struct.pack("<q", -1000 * i))]))
            yield pd.DataFrame({"id": pdf["event_id"], "document": out})

    return capture.flattened(e.select(F.col("event_id").cast("long").alias("event_id")).mapInPandas(build, "id long, document binary"))


_paths = {"a": "event_id", "b/c": "event_id * 10000000000", "b/d/0": "event_id", "b/d/1": "event_id % 2", "t/t": "event_id", "t/i": "3", "z": "-1000 * event_id"}
on_events("o08_flattened_documents", _flattened, " UNION ALL ".join(f"SELECT event_id AS id, {k} AS position, '{p}' AS path, {v} AS value FROM events" for k, (p, v) in enumerate(_paths.items())))

# captures and their store: a block for each file, path and day
_one = ", one AS (SELECT file_id, path, ts_ms, COALESCE(FIRST(value ORDER BY block_start, block_ordinal, point_idx), 0) AS value FROM samples WHERE path <> 'start' GROUP BY 1, 2, 3)"
_merged_one = _one + ", m AS (SELECT path, ts_ms, FIRST(value ORDER BY file_id) AS value FROM one GROUP BY 1, 2)"
_parts = _one + ", b AS (SELECT file_id, path, FLOOR(ts_ms / 86400000) AS day, COUNT(*) - 1 AS num_deltas, MIN(ts_ms) AS start_ms, MAX(ts_ms) AS end_ms FROM one GROUP BY 1, 2, 3), p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY path, day) - 1 AS block_ordinal FROM b)"
_built: dict[tuple[str, str], tuple[MetricStore, list[str]]] = {}


def _store(spark: SparkSession, sf_dir: str) -> tuple[MetricStore, list[str]]:
    """The store of three capture files of the samples, once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        first = F.struct("block_start", "block_ordinal", "point_idx")
        one = frame(spark, sf_dir, "samples").where("path <> 'start'").groupBy("file_id", "path", "ts_ms").agg(F.min_by(F.struct("value"), first)["value"].alias("value"))

        def encode(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts_ms")
            block = capture.encode_block(["start", pdf["path"].iloc[0]], pdf[["ts_ms", "value"]].to_numpy().T)
            return pd.DataFrame({"file_id": pdf["file_id"].head(1), "part": [f"{pdf['path'].iloc[0]}\0{int(pdf['day'].iloc[0]):09d}"], "content": [block]})

        points = one.select("file_id", "path", "ts_ms", F.coalesce("value", F.lit(0)).alias("value"), F.floor(F.col("ts_ms") / 86_400_000).alias("day"))
        documents = points.groupBy("file_id", "path", "day").applyInPandas(encode, "file_id int, part string, content binary")
        folder = _folder(spark)
        paths = capture.write_files(documents, f"{folder}/captures")
        _built[key] = MetricStore.build(spark, paths, f"{folder}/store"), paths
    return _built[key]


def on_store(name: str, plan, sql: str) -> None:
    Q[name] = lambda spark, sf_dir: plan(*_store(spark, sf_dir))
    SQL[name] = duck("samples").rstrip() + sql


def _wanted(store: MetricStore, paths: list[str]) -> DataFrame:
    group = store.groups().where("name = 'opcounters'").first()
    rows = capture.samples_of_blocks(capture.read_blocks(store.spark, paths), list(group.paths))
    return rows.select("file_id", "path", "ts_ms", "value")


on_store("o09_selected_columns", _wanted, f"{_one} SELECT file_id, path, ts_ms, value FROM one WHERE STARTS_WITH(path, 'serverStatus/opcounters/')")
on_store("o11_indexed_samples", lambda store, _: S.merged(store.samples().where("path <> 'start'")), f"{_merged_one} SELECT * FROM m")
on_store(
    "o15_published_index", lambda store, _: store.blocks().select("file_id", "block_ordinal", F.element_at("paths", 2).alias("path"), "num_deltas", "start_ms", "end_ms", F.col("point_offset").cast("bigint").alias("point_offset")),
    f"{_parts} SELECT file_id, block_ordinal, path, num_deltas, start_ms, end_ms, CAST(COALESCE(SUM(num_deltas + 1) OVER (PARTITION BY file_id ORDER BY block_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS point_offset FROM p",
)
on_store("o16_catalog_paths", lambda store, _: store.catalog()["paths"], f"{_parts}, f AS (SELECT path, MIN(ROW(file_id, block_ordinal)) AS seen FROM p GROUP BY 1) SELECT ROW_NUMBER() OVER (ORDER BY seen) AS place, path FROM f UNION ALL SELECT 0, 'start'")


def _exported(store: MetricStore, _: list[str]) -> DataFrame:
    out = _folder(store.spark)
    store.export_csv("flat", out)
    return store.spark.read.option("header", True).schema("timestampEpochMillis long, value long").csv(out)


on_store("o17_exported_csv", _exported, f"{_merged_one} SELECT ts_ms AS timestampEpochMillis, value FROM m WHERE path = 'flat'")
on_store("o117_single_series", lambda store, _: store.series("flat", max_points=500), _down(_one + ", m AS (SELECT path, ts_ms, FIRST(value ORDER BY file_id) AS value FROM one WHERE path = 'flat' GROUP BY 1, 2)", 500))


# source files: what they held, and which are no longer as they were
def _manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    return capture.manifest(spark, paths).withColumn("path", F.regexp_extract("path", "/([0-2])/[^/]*$", 1))


def _held(e: DataFrame) -> DataFrame:
    return _manifest(e.sparkSession, _written_lines(e.sparkSession, e.selectExpr("event_id % 3 AS file", "event_id AS place", f"{_LINE} AS value")))


def _changed(e: DataFrame) -> DataFrame:
    rows = e.selectExpr("event_id % 3 AS file", "event_id AS place", f"{_LINE} AS value")
    then = _held(e)
    now = _written_lines(e.sparkSession, rows.withColumn("value", F.when(F.col("file") == 1, F.concat("value", F.lit("."))).otherwise(F.col("value"))))
    return capture.changed(then, _manifest(e.sparkSession, now))


_files = f"SELECT CAST(event_id % 3 AS VARCHAR) AS path, CAST(SUM(STRLEN({_LINE}) + 1) AS BIGINT) AS size, SHA256(STRING_AGG(CONCAT({_LINE}, CHR(10)), '' ORDER BY event_id)) AS sha256 FROM events GROUP BY 1"
on_events("o12_source_manifest", _held, _files)
on_events("o52_changed_sources", _changed, f"SELECT * FROM ({_files}) f WHERE path = '1'")


# stored results, read again
def _json(df: DataFrame, name: str) -> DataFrame:
    folder = _folder(df.sparkSession)
    for _ in range(2):  # a result replaces the one before
        publish(df, f"{folder}/{name}", "json", ignoreNullFields="false")
    return written(df.sparkSession, folder, name, df)


add("o13_written_summary", "slow", lambda s: _json(A.by_namespace(s), "summary/by_namespace"), stat_by("namespace", unknown("namespace"), "response_bytes DESC, n DESC, namespace LIMIT 20"))
add("o14_written_details", "slow", lambda s: _json(A.slowest(s.select(*_keep)), "summary/slowest"), f"SELECT {', '.join(_keep)} FROM ({_top}) t")


def _reopened(e: DataFrame) -> DataFrame:
    spark = e.sparkSession
    paths = _written_lines(spark, e.select(F.col("file_index").alias("file"), F.col("line_number").alias("place"), F.expr(_JSON.rsplit(" AS ", 1)[0]).alias("value")))
    store = _folder(spark)
    LogAnalysis.from_paths(spark, paths, store)
    return A.by_operation(LogAnalysis.open(spark, store, paths).slow)


add("o10_reopened_analysis", "entries", _reopened, f"SELECT operation, {STAT} FROM entries WHERE duration_ms IS NOT NULL GROUP BY 1")

# the reservoir, with 64-bit arithmetic that wraps
_wide = "18446744073709551616::UHUGEINT"
_times = "CAST(CAST({x} AS UHUGEINT) * CAST({k} AS UHUGEINT) % " + _wide + " AS UBIGINT)"
SQL["o103_reservoir"] = duck("samples").rstrip() + f""", m AS (SELECT DISTINCT path, ts_ms FROM samples), s AS (SELECT path, ts_ms, ts_ms - LAG(ts_ms) OVER (PARTITION BY path ORDER BY ts_ms) AS gap_ms FROM m),
  o AS (SELECT path, gap_ms, CAST(ROW_NUMBER() OVER (PARTITION BY path ORDER BY ts_ms) AS UBIGINT) AS i FROM s WHERE gap_ms > 0),
  a AS (SELECT *, {_times.format(x='XOR(i, i >> 30)', k='13787848793156543929')} AS x FROM o), b AS (SELECT *, {_times.format(x='XOR(x, x >> 27)', k='10723151780598845931')} AS y FROM a),
  c AS (SELECT path, gap_ms, i, CASE WHEN i <= 4096 THEN i - 1 ELSE XOR(y, y >> 31) % i END AS slot FROM b) SELECT path, CAST(slot AS BIGINT) AS slot, ARG_MAX(gap_ms, i) AS gap_ms FROM c WHERE slot < 4096 GROUP BY 1, 2"""
