"""Every query of the engine by name, over the tables of `canonical`, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redacted
from ..functions.text import host_of, query_shape
from ..functions.values import count_of, exact_long
from ..operators import diagnostics as D
from ..operators import logs
from ..operators import series as S
from ..operators import summary as A
from ..sources import capture
from .canonical import duck, frame

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STAT = """COUNT(*) AS n, CAST(SUM(duration_ms) AS BIGINT) AS total_ms, CAST(SUM(duration_ms) AS DOUBLE) / COUNT(*) AS avg_ms, MIN(duration_ms) AS min_ms, MAX(duration_ms) AS max_ms,
  CAST(SUM(COALESCE(response_len, 0)) AS BIGINT) AS response_bytes, CAST(SUM(COALESCE(cpu_nanos, 0)) AS BIGINT) AS cpu_nanos"""
PRESENT = "entries WHERE status IN ('SUCCESS', 'PARTIAL')"
SLOW_ROWS = PRESENT + " AND is_slow AND duration_ms IS NOT NULL"


def unknown(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR TRIM({c}) = '' THEN 'unknown' ELSE {c} END"


def add(name: str, table: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    Q[name] = lambda spark, sf_dir: plan(frame(spark, sf_dir, table))
    if sql is not None:
        SQL[name] = duck(table) + sql if not sql.startswith(",") else duck(table).rstrip() + sql


def stat_by(c: str, key: str, tail: str) -> str:
    return f"SELECT {key} AS {c}, {STAT} FROM slow GROUP BY 1 ORDER BY {tail}"


# reports over slow queries
add("o53_stat_by_namespace", "slow", lambda s: A.by(s, F.col("namespace"), "namespace"), f"SELECT {unknown('namespace')} AS namespace, {STAT} FROM slow GROUP BY 1")
add("o54_line_counts", "entries", A.line_counts, "SELECT COUNT(*) AS total, " + ", ".join(f"COUNT(*) FILTER (status = '{x}') AS {x.lower()}" for x in ("SUCCESS", "PARTIAL", "SKIPPED", "FAILED")) + " FROM entries")
add("o55_parse_errors", "entries", A.parse_errors, "SELECT error_code, COUNT(*) AS n FROM entries WHERE error_code IS NOT NULL GROUP BY 1")
add("o56_time_range", "entries", A.time_range, f"SELECT MIN(ts_ms) AS first_ms, MAX(ts_ms) AS last_ms FROM {PRESENT}")
add(
    "o57_totals", "entries", A.totals,
    f"""SELECT COUNT(*) FILTER (is_slow AND duration_ms IS NOT NULL) AS slow_queries, CAST(COALESCE(SUM(duration_ms) FILTER (is_slow), 0) AS BIGINT) AS total_ms,
    COUNT(*) FILTER (heartbeat_failure) AS heartbeat_failures, COALESCE(BOOL_OR(is_slow AND duration_ms IS NOT NULL AND cpu_nanos IS NOT NULL), FALSE) AS cpu_available FROM {PRESENT}""",
)
_bucket_rows = ", ".join(f"({i}, '{k}', '{lab}', {lo}, {hi if hi is not None else '9223372036854775807'})" for i, (k, lab, lo, hi) in enumerate(A.BUCKETS))
add(
    "o58_duration_histogram", "slow", A.duration_histogram,
    f""", b AS (SELECT * FROM (VALUES {_bucket_rows}) v(position, bucket, label, lo, hi)),
    c AS (SELECT position, bucket, label, COUNT(duration_ms) AS n, COALESCE(SUM(duration_ms), 0) AS t, COALESCE(MAX(duration_ms), 0) AS max_ms FROM b LEFT JOIN slow ON duration_ms >= lo AND duration_ms < hi GROUP BY 1, 2, 3)
    SELECT position, bucket, label, n, CASE WHEN SUM(n) OVER () > 0 THEN CAST(n AS DOUBLE) * 100 / CAST(SUM(n) OVER () AS DOUBLE) ELSE 0 END AS percent, CAST(t AS BIGINT) AS total_ms, CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n ELSE 0 END AS avg_ms, max_ms FROM c""",
)
add("o59_by_operation", "slow", A.by_operation, stat_by("operation", unknown("operation"), "n DESC, operation"))
add("o60_by_namespace", "slow", A.by_namespace, stat_by("namespace", unknown("namespace"), "response_bytes DESC, n DESC, namespace LIMIT 20"))
add("o61_by_pattern", "slow", A.by_pattern, stat_by("query_pattern", unknown("query_pattern"), "n DESC, query_pattern LIMIT 50"))
add("o62_by_plan", "slow", A.by_plan, stat_by("plan_summary", unknown("plan_summary"), "n DESC, plan_summary"))
add("o63_by_remote", "slow", A.by_remote, stat_by("remote", unknown("remote"), "response_bytes DESC, n DESC, remote LIMIT 20"))
add("o64_cpu_by_operation_namespace", "slow", A.cpu_by_operation_namespace, f"SELECT CONCAT({unknown('operation')}, '|', {unknown('namespace')}) AS operation_namespace, {STAT} FROM slow WHERE cpu_nanos IS NOT NULL GROUP BY 1")
_top = "SELECT * FROM slow ORDER BY duration_ms DESC, ts_ms, file_index, line_number LIMIT 5000"
_pattern = f"""SELECT {unknown('namespace')} AS namespace, {unknown('operation')} AS operation, {unknown('query_pattern')} AS query_pattern, {STAT},
  COALESCE(STRING_AGG(DISTINCT CASE WHEN TRIM(plan_summary) <> '' THEN plan_summary END, '; ' ORDER BY CASE WHEN TRIM(plan_summary) <> '' THEN plan_summary END), '') AS plans, BOOL_OR(cpu_nanos IS NOT NULL) AS cpu_available,
  FIRST(ts_ms ORDER BY duration_ms DESC, ts_ms, file_index, line_number) AS slowest_ts_ms, FIRST(query_id ORDER BY duration_ms DESC, ts_ms, file_index, line_number) AS sample_id FROM slow GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 50"""
_pattern_all = f""", p AS ({_pattern}), t AS ({_top}) SELECT p.* EXCLUDE (sample_id), t.query_id AS slowest_query_id FROM p LEFT JOIN t ON t.query_id = p.sample_id"""
add("o65_pattern_stats", "slow", A.pattern_stats, _pattern_all)
add("o66_namespace_bytes", "slow", A.namespace_bytes, f"SELECT {unknown('namespace')} AS namespace, CAST(SUM(COALESCE(response_len, 0)) AS BIGINT) AS response_bytes FROM slow GROUP BY 1")
_cpu = """SELECT operation, bucket, COUNT(*) AS n FROM (SELECT CASE WHEN operation = 'remove' THEN 'delete' ELSE operation END AS operation,
  CAST(CEIL(FLOOR(CAST(cpu_nanos AS DOUBLE) / CAST(1000000 AS DOUBLE) / duration_ms * 100) / 10) * 10 AS BIGINT) AS bucket FROM slow WHERE cpu_nanos IS NOT NULL AND duration_ms > 0) x WHERE operation IN ('insert', 'update', 'delete', 'find') GROUP BY 1, 2"""
add("o67_cpu_ratio_histogram", "slow", A.cpu_ratio_histogram, _cpu)
_hours = f"""SELECT CAST(FLOOR(ts_ms / 3600000) * 3600000 AS BIGINT) AS hour_ms, COUNT(*) AS n, CAST(SUM(c) AS DOUBLE) / COUNT(*) AS avg_connections FROM (SELECT ts_ms, COALESCE(connection_count,
  CASE WHEN UPPER(component) = 'NETWORK' THEN TRY_CAST(NULLIF(REGEXP_EXTRACT(message, '\\((\\d+) connections now open\\)', 1), '') AS BIGINT) END) AS c FROM {PRESENT}) x WHERE c >= 0 GROUP BY 1"""
add("o68_connections_by_hour", "entries", A.connections_by_hour, _hours)
add("o83_top_bytes", "slow", lambda s: A.by_remote(s, 5), stat_by("remote", unknown("remote"), "response_bytes DESC, n DESC, remote LIMIT 5"))
_keep = ["query_id", "ts_ms", "duration_ms", "file_index", "line_number", "namespace", "operation"]
add("o84_slowest", "slow", lambda s: A.slowest(s.select(*_keep)), f"SELECT {', '.join(_keep)} FROM ({_top}) t")
add("o85_pattern_ranking", "slow", lambda s: A.pattern_stats(s).select("namespace", "operation", "query_pattern", "n"), f"SELECT namespace, operation, query_pattern, n FROM ({_pattern}) p")
add("o36_or_unknown", "entries", lambda e: e.groupBy(A.or_unknown(F.col("namespace")).alias("namespace"), A.or_unknown(F.col("severity")).alias("severity")).agg(F.count("*").alias("n")), f"SELECT {unknown('namespace')} AS namespace, {unknown('severity')} AS severity, COUNT(*) AS n FROM entries GROUP BY 1, 2")
add("o38_filtered", "slow", lambda s: A.matching(A.slowest(s), " DB.C1 ", "FIND", "ixscan", 1000).select(*_keep), f"SELECT {', '.join(_keep)} FROM ({_top}) t WHERE CONTAINS(LOWER(namespace), 'db.c1') AND CONTAINS(LOWER(operation), 'find') AND CONTAINS(LOWER(plan_summary), 'ixscan') AND duration_ms >= 1000")
add("o39_pattern_filter", "slow", lambda s: A.pattern_rows(A.pattern_stats(s), "c1", "find", "ix").select("namespace", "operation", "query_pattern", "n", "plans"), f"SELECT namespace, operation, query_pattern, n, plans FROM ({_pattern}) p WHERE (CONTAINS(LOWER(namespace), 'c1') OR CONTAINS(LOWER(query_pattern), 'c1')) AND operation = 'find' AND CONTAINS(LOWER(plans), 'ix')")
add("o47_slowest_in_top", "slow", lambda s: A.pattern_stats(s, 50, 20).select("namespace", "operation", "query_pattern", "slowest_query_id"), f", p AS ({_pattern}), t AS (SELECT query_id FROM slow ORDER BY duration_ms DESC, ts_ms, file_index, line_number LIMIT 20) SELECT namespace, operation, query_pattern, t.query_id AS slowest_query_id FROM p LEFT JOIN t ON t.query_id = p.sample_id")
add("o51_by_query_id", "slow", lambda s: s.where("query_id = '1-40'").select(*_keep, "severity", "component", "message"), f"SELECT {', '.join(_keep)}, severity, component, message FROM slow WHERE query_id = '1-40'")
add("o92_connection_points", "entries", lambda e: A.connection_points(A.connections_by_hour(e)), f", h AS ({_hours}), m AS (SELECT *, LEAD(hour_ms) OVER (ORDER BY hour_ms) AS nx FROM h) SELECT hour_ms, avg_connections FROM h UNION ALL SELECT hour_ms + 3600000, NULL FROM m WHERE nx - hour_ms > 3600000")
add("o93_page", "slow", lambda s: A.page(A.slowest(s.select(*_keep)), 3, 50, *A.ranking()), f", t AS ({_top}) SELECT {', '.join(_keep)}, (SELECT COUNT(*) FROM t) AS total FROM t ORDER BY duration_ms DESC, ts_ms, file_index, line_number LIMIT 50 OFFSET 100")
add("o95_resorted", "slow", lambda s: A.resorted(s.groupBy("plan_summary").agg(F.count("*").alias("n")), "plan_summary", True), "SELECT plan_summary, COUNT(*) AS n FROM slow GROUP BY 1")
add("o101_operations", "slow", A.operations, "SELECT DISTINCT operation FROM slow")
add("o108_scatter", "slow", A.scatter, f", t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY duration_ms DESC, ts_ms, file_index, line_number) AS p FROM ({_top}) x), u AS (SELECT {unknown('namespace')} AS ns, CAST(p AS INT) AS place, ts_ms, duration_ms, query_id FROM t) SELECT MIN(place) OVER (PARTITION BY ns) AS series_place, ns AS namespace, place, ts_ms, duration_ms, query_id FROM u")
add("o112_share", "slow", lambda s: A.share(A.by_operation(s), "operation"), "SELECT operation, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) * 100 / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS percent FROM slow GROUP BY 1")
add("o113_cpu_labels", "slow", lambda s: A.cpu_ratio_histogram(s).select("operation", A.cpu_bucket_label(F.col("bucket")).alias("label"), "n"), f"SELECT operation, CASE WHEN bucket = 0 THEN '[0,1)%' ELSE CONCAT('[', bucket - 9, ',', bucket + 1, ')%') END AS label, n FROM ({_cpu}) c")

# diagnostics
add("o69_severities", "entries", D.severities, f"SELECT 'severity' AS kind, {unknown('severity')} AS value, COUNT(*) AS n FROM {PRESENT} GROUP BY 2 UNION ALL SELECT 'component', {unknown('component')}, COUNT(*) FROM {PRESENT} GROUP BY 2")
add("o70_quality", "entries", D.quality, f"SELECT COUNT(*) FILTER (NOT legacy) AS structured, COUNT(*) FILTER (legacy) AS legacy, COUNT(*) FILTER (NOT legacy AND truncated) AS truncated, COUNT(*) FILTER (NOT legacy AND tagged) AS tagged FROM {PRESENT}")
_names = {"service": "service", "server_version": "server_version", "application": "application", "driver": "driver", "query_framework": "CASE WHEN is_slow AND duration_ms IS NOT NULL THEN query_framework END"}
_name_rows = " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value, {D.CAPACITY[k]} AS cap FROM {PRESENT}" for k, v in _names.items())
add("o71_frequent_names", "entries", D.frequent_names, f", x AS ({_name_rows}), c AS (SELECT kind, value, cap, COUNT(*) AS n FROM x WHERE TRIM(value) <> '' GROUP BY 1, 2, 3), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY n DESC, value) AS i, COUNT(*) OVER (PARTITION BY kind) AS d FROM c) SELECT kind, value, n, d > cap AS approximate FROM r WHERE i <= 20")
add("o72_shapes", "entries", D.shapes, f"SELECT LEAST(COUNT(DISTINCT COALESCE(NULLIF(TRIM(plan_shape_hash), ''), NULLIF(TRIM(query_hash), ''), query_pattern)), 10000) AS shapes FROM {SLOW_ROWS}")
_abn = f"""k AS (SELECT *, CONCAT({unknown('component')}, '|', COALESCE(CAST(message_id AS VARCHAR), {unknown('message')})) AS key FROM {PRESENT} AND ({unknown('severity')} LIKE 'W%' OR {unknown('severity')} LIKE 'E%' OR {unknown('severity')} LIKE 'F%')),
  g AS (SELECT key, COUNT(*) AS n, MIN(ts_ms) AS first_ms, MAX(ts_ms) AS last_ms, MIN(ROW(file_index, line_number)) AS a FROM k GROUP BY 1 ORDER BY a LIMIT 500)"""
add(
    "o73_abnormal_events", "entries", lambda e: D.abnormal(e).drop("samples"),
    f", {_abn} SELECT g.key, k.severity, k.component, k.message_id, COALESCE(k.message, '') AS message, n, first_ms, last_ms FROM g JOIN k ON g.key = k.key AND ROW(k.file_index, k.line_number) = g.a",
)
add(
    "o91_event_samples", "entries", lambda e: D.abnormal(e).select("key", F.posexplode("samples").alias("i", "s")).select("key", F.col("i").cast("bigint").alias("i"), "s.ts_ms", "s.message"),
    f", {_abn}, r AS (SELECT key, ts_ms, message, ROW_NUMBER() OVER (PARTITION BY key ORDER BY file_index, line_number) - 1 AS i FROM k) SELECT r.key, i, ts_ms, COALESCE(message, '') AS message FROM r JOIN g ON g.key = r.key WHERE i < 3",
)
_acc = "(LOWER(COALESCE(message, '')) = 'connection accepted' OR LOWER(COALESCE(message, '')) LIKE 'connection accepted from%')"
_end = "(LOWER(COALESCE(message, '')) = 'connection ended' OR LOWER(COALESCE(message, '')) LIKE 'end connection%')"
add("o74_connections", "entries", D.connections, f"""SELECT COUNT(*) FILTER ({_acc}) AS accepted, COUNT(*) FILTER ({_end}) AS ended, COUNT(*) FILTER (LOWER(message) = 'successfully authenticated') AS authenticated,
  COUNT(*) FILTER (LOWER(message) = 'connection not authenticating') AS not_authenticating, COUNT(*) FILTER (LOWER(message) LIKE '%attempted to reauthenticate%') AS reauthentications, COUNT(connection_count) AS samples,
  MIN(connection_count) AS min_connections, MAX(connection_count) AS max_connections, CAST(SUM(connection_count) AS DOUBLE) / COUNT(connection_count) AS avg_connections FROM {PRESENT}""")
_kind = "CASE " + " ".join("WHEN " + " OR ".join([f"LOWER(message) LIKE '%{p}%'" for p in parts] + (["UPPER(component) = 'ELECTION'"] if k == "ELECTION" else [])) + f" THEN '{k}'" for k, parts in D.REPLICATION) + " END"
add(
    "o75_replication", "entries", D.replication,
    f""", e AS (SELECT *, {_kind} AS kind FROM {PRESENT}), k AS (SELECT *, CONCAT(kind, '|', COALESCE(CAST(message_id AS VARCHAR), {unknown('message')})) AS key FROM e WHERE kind IS NOT NULL),
    g AS (SELECT key, COUNT(*) AS n, MIN(ts_ms) AS first_ms, MAX(ts_ms) AS last_ms, MIN(ROW(file_index, line_number)) AS a FROM k GROUP BY 1 ORDER BY a LIMIT 100)
    SELECT g.key, k.kind, k.component, k.message_id, COALESCE(k.message, '') AS message, n, first_ms, last_ms FROM g JOIN k ON g.key = k.key AND ROW(k.file_index, k.line_number) = g.a""",
)


def _timeline(points: int) -> str:
    flags = [f"{unknown('severity')} LIKE '{x}%'" for x in "WEF"] + [_acc, _end, f"({_kind}) IS NOT NULL"]
    cols = ", ".join(f"SUM(CASE WHEN {f} THEN 1 ELSE 0 END) AS {n}" for f, n in zip(flags, D.TIMELINE))
    return f""", h AS (SELECT CAST(FLOOR(ts_ms / 3600000) * 3600000 AS BIGINT) AS hour_ms, {cols} FROM {PRESENT} AND ({' OR '.join(flags)}) GROUP BY 1),
    w AS (SELECT 3600000 * CAST(POW(2, k) AS BIGINT) AS width FROM range(31) r(k)), d AS (SELECT width, COUNT(DISTINCT FLOOR(hour_ms / width)) AS c FROM h, w GROUP BY 1), m AS (SELECT MIN(width) AS width FROM d WHERE c <= {points}),
    t AS (SELECT width AS width_ms, CAST(FLOOR(hour_ms / width) * width AS BIGINT) AS bucket_ms, {', '.join(f'CAST(SUM({n}) AS BIGINT) AS {n}' for n in D.TIMELINE)} FROM h, m GROUP BY 1, 2) """


add("o76_timeline", "entries", D.timeline, _timeline(2000) + "SELECT * FROM t")
add("o76_timeline_narrow", "entries", lambda e: D.timeline(e, 50), _timeline(50) + "SELECT * FROM t")
add("o111_timeline_series", "entries", lambda e: D.timeline_series(D.timeline(e, 200)), _timeline(200) + " UNION ALL ".join(f"SELECT bucket_ms, '{n}' AS series, {n} AS n FROM t" for n in D.TIMELINE))
_sig = {
    "collscan": "plan_summary LIKE '%COLLSCAN%'", "high_docs_ratio": "returned > 0 AND CAST(docs_examined AS DOUBLE) / returned >= 100", "high_keys_ratio": "returned > 0 AND CAST(keys_examined AS DOUBLE) / returned >= 100",
    "zero_return_scan": "returned = 0 AND docs_examined >= 1000", "storage_dominant": "storage_micros >= duration_ms * 500", "planning_dominant": "planning_micros >= duration_ms * 500", "write_concern_wait": "write_concern_ms > 0",
    "flow_control_wait": "flow_control_micros > 0", "lock_wait": "lock_micros > 0", "remote_wait": "remote_wait_ms > 0", "authorization_wait": "authorization_micros > 0", "queue_wait": "queue_micros > 0", "oplog_slot_wait": "oplog_slot_micros > 0",
    "sort_stage": "has_sort", "used_disk": "used_disk", "spilled": "(spills > 0 OR spilled_bytes > 0 OR spilled_records > 0)",
}
_sig_counts = "SELECT COUNT(*) AS slow_total, " + ", ".join(f"COUNT(*) FILTER ({p}) AS {n}" for n, p in _sig.items()) + f" FROM {SLOW_ROWS}"
add("o77_signal_counts", "entries", D.signal_counts, _sig_counts)
add("o110_signal_table", "entries", D.signal_table, f", c AS ({_sig_counts}) " + " UNION ALL ".join(f"SELECT '{n}' AS signal, {n} AS n FROM c" for n in _sig))
_cov = {
    "planSummary": "plan_summary IS NOT NULL", "docsExamined": "docs_examined IS NOT NULL", "keysExamined": "keys_examined IS NOT NULL", "nreturned": "returned IS NOT NULL", "queryHash": "query_hash IS NOT NULL", "planCacheKey": "plan_cache_key IS NOT NULL",
    "planCacheShapeHash": "plan_shape_hash IS NOT NULL", "queryShapeHash": "query_shape_hash IS NOT NULL", "planningTimeMicros": "planning_micros IS NOT NULL", "storage.data.bytesRead": "bytes_read IS NOT NULL", "storage.data.timeReadingMicros": "storage_micros IS NOT NULL",
    "flowControl": "has_flow_control", "waitForWriteConcernDurationMillis": "write_concern_ms IS NOT NULL", "locks": "has_locks", "queryFramework": "query_framework IS NOT NULL", "queues": "has_queues", "workingMillis": "working_ms IS NOT NULL", "remoteOpWaitMillis": "remote_wait_ms IS NOT NULL",
    "authorization.userCacheWaitTimeMicros": "authorization_micros IS NOT NULL", "cpuNanos": "cpu_nanos IS NOT NULL", "totalOplogSlotDurationMicros": "oplog_slot_micros IS NOT NULL", "spilledBytes": "spilled_bytes > 0", "spilledRecords": "spilled_records > 0",
}
add("o78_coverage", "entries", D.coverage, ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS field, COUNT(*) FILTER ({p}) AS n FROM {SLOW_ROWS}" for n, p in _cov.items()) + ") SELECT * FROM x WHERE n > 0")
_any = " OR ".join(f"({p})" for p in _sig.values())
_why = ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in _sig.items())
_n_why = " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in _sig.values())
add(
    "o79_insights", "entries", lambda e: D.insights(e).withColumn("reasons", F.array_join("reasons", ",")),
    f"""SELECT file_index, line_number, ts_ms, namespace, operation, query_pattern, COALESCE(NULLIF(TRIM(plan_shape_hash), ''), NULLIF(TRIM(query_hash), '')) AS shape_hash, plan_cache_key, plan_summary, duration_ms, docs_examined, keys_examined, returned,
    CASE WHEN returned > 0 THEN CAST(docs_examined AS DOUBLE) / returned END AS docs_ratio, CASE WHEN returned > 0 THEN CAST(keys_examined AS DOUBLE) / returned END AS keys_ratio, CAST(storage_micros AS DOUBLE) / 1000 AS storage_ms, CAST(planning_micros AS DOUBLE) / 1000 AS planning_ms,
    write_concern_ms, CAST(flow_control_micros AS DOUBLE) / 1000 AS flow_control_ms, CAST(lock_micros AS DOUBLE) / 1000 AS lock_ms, CONCAT_WS(',', {_why}) AS reasons FROM {SLOW_ROWS} AND ({_any}) ORDER BY {_n_why} DESC, duration_ms DESC, ts_ms DESC, file_index, line_number LIMIT 50""",
)
add("o87_out_of_order", "entries", D.out_of_order, f", x AS (SELECT file_index, ts_ms < LAG(ts_ms) OVER (PARTITION BY file_index ORDER BY line_number) AS late FROM {PRESENT}) SELECT file_index, COUNT(*) FILTER (late) AS out_of_order FROM x GROUP BY 1")
add("o109_overview", "entries", D.overview, f", e AS (SELECT *, {_kind} AS kind FROM {PRESENT}) SELECT COUNT(*) FILTER ({unknown('severity')} LIKE 'W%' OR {unknown('severity')} LIKE 'E%' OR {unknown('severity')} LIKE 'F%') AS abnormal, COUNT(kind) AS replication, COUNT(DISTINCT kind) AS replication_kinds, COUNT(*) FILTER (is_slow AND duration_ms IS NOT NULL AND ({_any})) AS with_signals, COUNT(*) FILTER (is_slow AND duration_ms IS NOT NULL) AS slow_total FROM e")
add("o114_observations", "entries", lambda e: D.explanations(e).select("query_id", F.array_join("observations", ",").alias("observations"), F.size("rows").cast("bigint").alias("n_rows")), f"""SELECT CONCAT(file_index, '-', line_number) AS query_id, CONCAT_WS(',', {_why}) AS observations,
  1 + (CASE WHEN plan_summary IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN NOT legacy AND docs_examined IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN NOT legacy AND keys_examined IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN NOT legacy AND returned IS NOT NULL THEN 1 ELSE 0 END)
  + (CASE WHEN NOT legacy AND returned > 0 AND docs_examined IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN response_len IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN cpu_nanos IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN lock_micros > 0 THEN 1 ELSE 0 END) + CAST(0 AS BIGINT) AS n_rows FROM {SLOW_ROWS}""")
Q["o37_redacted_documents"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", redacted(F.col("text")).alias("text"))

# metric series
_merged = ", m AS (SELECT path, ts_ms, FIRST(value ORDER BY file_id, block_start, block_ordinal, point_idx) AS value FROM samples GROUP BY 1, 2)"
_delta = ", d AS (SELECT path, ts_ms, value - LAG(value) OVER (PARTITION BY path ORDER BY ts_ms) AS value FROM m)"
_group = "REGEXP_REPLACE(CASE " + " ".join(f"WHEN STARTS_WITH(path, '{p}') THEN '{p}'" for p in S.SPECIAL_PREFIXES) + " WHEN REGEXP_MATCHES(path, '^.+/[^/]*$') THEN REGEXP_EXTRACT(path, '^(.+)/[^/]*$', 1) ELSE path END, '^serverStatus/', '')"
_range = (1704240000000, 1705000000000)
_query = S.Query(*_range, 200)


def _stats(t: str) -> str:
    return f"SELECT path, COUNT(value) AS n, MIN(value) AS min_value, MAX(value) AS max_value, CAST(SUM(value) AS DOUBLE) / NULLIF(COUNT(value), 0) AS avg_value, COALESCE(MIN(value) = 0 AND MAX(value) = 0, FALSE) AS all_zero FROM {t} GROUP BY 1"


add("o42_range", "samples", lambda s: S.view(S.merged(s), _query), f"{_merged} SELECT * FROM m WHERE ts_ms BETWEEN {_range[0]} AND {_range[1]}")
add("o43_kept_paths", "samples", lambda s: s.select("path").distinct().where(~F.col("path").isin(*S.EXCLUDED)), "SELECT DISTINCT path FROM samples WHERE path NOT IN ('" + "', '".join(S.EXCLUDED) + "')")
add("o44_merged", "samples", S.merged, f"{_merged} SELECT * FROM m")
add("o45_group_merged", "samples", lambda s: S.merged(s).join(S.groups(s).select("path", "name"), "path"), f"{_merged} SELECT m.*, {_group} AS name FROM m WHERE path NOT IN ('" + "', '".join(S.EXCLUDED) + "')")
add("o46_increasing", "samples", S.increasing, """, g AS (SELECT *, MAX(ts_ms) OVER (PARTITION BY path, file_id ORDER BY block_start, block_ordinal, point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM samples)
  SELECT path, ts_ms, FIRST(value ORDER BY file_id, block_start, block_ordinal, point_idx) AS value FROM g WHERE seen IS NULL OR ts_ms > seen GROUP BY 1, 2""")
add("o49_overlapping_blocks", "blocks", lambda b: S.overlapping(b, *_range), f"SELECT * FROM blocks WHERE end_ms >= {_range[0]} AND start_ms <= {_range[1]}")
add("o80_stats", "samples", lambda s: S.stats(S.merged(s)), f"{_merged} {_stats('m')}")
add("o80_delta_stats", "samples", lambda s: S.stats(S.delta(S.merged(s))), f"{_merged}{_delta} {_stats('d')}")
add("o81_catalog_totals", "blocks", S.catalog_totals, "SELECT COUNT(*) AS blocks, CAST(SUM(num_deltas + 1) AS BIGINT) AS samples, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms FROM blocks")
add("o82_groups", "samples", S.groups, f"SELECT DISTINCT SUBSTR(SHA256({_group}), 1, 16) AS group_id, {_group} AS name, path, SUBSTR(SHA256(path), 1, 16) AS metric_id FROM samples WHERE path NOT IN ('" + "', '".join(S.EXCLUDED) + "')")
add("o86_delta", "samples", lambda s: S.delta(S.merged(s)), f"{_merged}{_delta} SELECT * FROM d")
_steps = ", s AS (SELECT path, LAG(ts_ms) OVER (PARTITION BY path ORDER BY ts_ms) AS from_ms, ts_ms AS to_ms, ts_ms - LAG(ts_ms) OVER (PARTITION BY path ORDER BY ts_ms) AS gap_ms FROM m)"
add("o88_intervals", "samples", lambda s: S.intervals(S.merged(s)).drop("ordinal"), f"{_merged}{_steps} SELECT * FROM s WHERE gap_ms > 0")
add("o89_point_offsets", "blocks", lambda b: S.with_offsets(b).select("file_id", "block_ordinal", F.col("point_offset").cast("bigint").alias("point_offset")), "SELECT file_id, block_ordinal, CAST(COALESCE(SUM(num_deltas + 1) OVER (PARTITION BY file_id ORDER BY block_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS point_offset FROM blocks")
add("o90_ends", "samples", lambda s: S.ends(S.merged(s)), f"{_merged} SELECT path, COUNT(*) AS points, MIN(ts_ms) AS first_ms, ARG_MIN_NULL(value, ts_ms) AS first_value, MAX(ts_ms) AS last_ms, ARG_MAX_NULL(value, ts_ms) AS last_value FROM m GROUP BY 1")
add("o94_point_page", "samples", lambda s: S.page(S.merged(s.where("path = 'flat'")), 100, 50), f"{_merged}, f AS (SELECT * FROM m WHERE path = 'flat') SELECT *, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY ts_ms LIMIT 50 OFFSET 100")
add("o41_nonzero", "samples", lambda s: S.only_nonzero(S.merged(s)), f"{_merged} SELECT * FROM m WHERE path NOT IN (SELECT path FROM ({_stats('m')}) z WHERE all_zero)")
add("o40_chosen_groups", "samples", lambda s: S.chosen_groups(S.groups(s), ["opcounters"], ["wiredTiger"], "e").select("name", "path"), f"SELECT DISTINCT {_group} AS name, path FROM samples WHERE ({_group} = 'opcounters' OR STARTS_WITH({_group}, 'wiredTiger')) AND CONTAINS(LOWER({_group}), 'e') AND path NOT IN ('" + "', '".join(S.EXCLUDED) + "')")
_typical = """, p AS (SELECT path, PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY gap_ms) AS r FROM s WHERE gap_ms > 0 GROUP BY 1), y AS (SELECT s.path, PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY gap_ms) AS typical_ms FROM s JOIN p ON p.path = s.path WHERE gap_ms > 0 AND gap_ms <= r * 10 GROUP BY 1)"""


def _gaps(n: int) -> str:
    return f"""{_steps}{_typical}, gg AS (SELECT s.path, from_ms, to_ms, gap_ms, typical_ms, ROW_NUMBER() OVER (PARTITION BY s.path ORDER BY gap_ms DESC, from_ms) AS i FROM s JOIN y ON y.path = s.path WHERE gap_ms > typical_ms * 3), g AS (SELECT * EXCLUDE (i) FROM gg WHERE i <= {n})"""


add("o102_gaps", "samples", lambda s: S.gaps(S.merged(s), 1000), f"{_merged}{_gaps(1000)} SELECT * FROM g")
Q["o103_reservoir"] = lambda spark, sf_dir: S.reservoir_slots(S.intervals(S.merged(frame(spark, sf_dir, "samples"))))


def _down(source: str, n: int) -> str:
    b = max(0, (n - 2) // 2)
    edge = "(CASE WHEN first_ms = last_ms THEN 1 ELSE 2 END)"
    return f"""{source}{_gaps(n)}, e AS (SELECT path, COUNT(*) AS points, MIN(ts_ms) AS first_ms, ARG_MIN_NULL(value, ts_ms) AS first_value, MAX(ts_ms) AS last_ms, ARG_MAX_NULL(value, ts_ms) AS last_value FROM m GROUP BY 1),
    rg AS (SELECT g.*, first_ms, last_ms, ROW_NUMBER() OVER (PARTITION BY g.path ORDER BY gap_ms DESC, from_ms) AS i FROM g JOIN e ON e.path = g.path WHERE from_ms >= first_ms AND to_ms <= last_ms), kg AS (SELECT * FROM rg WHERE i <= {n} - {edge}),
    pl AS (SELECT e.*, COALESCE(c, 0) AS ng FROM e LEFT JOIN (SELECT path, COUNT(*) AS c FROM kg GROUP BY 1) q ON q.path = e.path), pt AS (SELECT *, points + ng <= {n} AS whole, GREATEST(0, FLOOR(({n} - {edge} - ng) / 2)) AS targets FROM pl),
    bd AS (SELECT MIN(ts_ms) AS rs, GREATEST(1, CEIL((MAX(ts_ms) - MIN(ts_ms) + 1) / CAST({max(1, b)} AS DOUBLE))) AS w FROM m),
    ct AS (SELECT m.path, m.ts_ms, m.value, LEAST(targets - 1, FLOOR(LEAST({max(0, b - 1)}, GREATEST(0, FLOOR((m.ts_ms - rs) / w))) * targets / {max(1, b)})) AS t FROM m JOIN pt ON pt.path = m.path, bd WHERE NOT whole AND value IS NOT NULL AND targets > 0),
    ex AS (SELECT path, t, FIRST(ts_ms ORDER BY value, ts_ms) AS lt, MIN(value) AS lv, FIRST(ts_ms ORDER BY value DESC, ts_ms) AS ht, MAX(value) AS hv FROM ct GROUP BY 1, 2),
    al AS (SELECT m.path, m.ts_ms, m.value FROM m JOIN pt ON pt.path = m.path WHERE whole UNION ALL SELECT path, lt, lv FROM ex UNION ALL SELECT path, ht, hv FROM ex UNION ALL SELECT path, first_ms, first_value FROM pt WHERE NOT whole UNION ALL SELECT path, last_ms, last_value FROM pt WHERE NOT whole
      UNION ALL SELECT path, from_ms + LEAST(gap_ms - 1, GREATEST(1, typical_ms)), NULL FROM kg), un AS (SELECT path, ts_ms, MAX(value) AS value FROM al GROUP BY 1, 2), nr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY path ORDER BY ts_ms) AS i FROM un)
    SELECT path, ts_ms, value FROM nr WHERE i <= {n}"""


add("o104_gap_markers", "samples", lambda s: S.downsampled(S.merged(s), S.Query(max_points=1000)).where("value IS NULL"), _down(_merged, 1000).replace("SELECT path, ts_ms, value FROM nr WHERE i <= 1000", "SELECT path, ts_ms, value FROM nr WHERE i <= 1000 AND value IS NULL"))
add("o105_downsampled", "samples", lambda s: S.downsampled(S.merged(s), S.Query(max_points=120)), _down(_merged, 120))
add("o106_pass_through", "samples", lambda s: S.downsampled(S.merged(s), S.Query(max_points=2000)), _down(_merged, 2000))


def _group_series(s: DataFrame) -> DataFrame:
    wanted = S.groups(s).where("name = 'opcounters'").select("path")
    found = S.downsampled(S.delta(S.merged(s.join(F.broadcast(wanted), "path", "left_semi"))), S.Query(max_points=300, view="delta"))
    return wanted.join(found, "path", "left")


add(
    "o107_group_series", "samples", _group_series,
    _down(", m0 AS (SELECT path, ts_ms, FIRST(value ORDER BY file_id, block_start, block_ordinal, point_idx) AS value FROM samples WHERE STARTS_WITH(path, 'serverStatus/opcounters/') GROUP BY 1, 2), m AS (SELECT path, ts_ms, value - LAG(value) OVER (PARTITION BY path ORDER BY ts_ms) AS value FROM m0)", 300),
)
# sources and parsers: rows are written in each format and read back
def _iso(ms: str, form: str) -> str:
    return f"date_format(timestamp_millis({ms}), '{form}')"


_JSON = f"""CONCAT('{{"t":{{"$date":"', {_iso("ts_ms", "yyyy-MM-dd''T''HH:mm:ss.SSS")}, '+00:00"}},"s":"', COALESCE(severity, '-'), '","c":"', COALESCE(component, '-'), '","id":', COALESCE(message_id, 7), ',"ctx":"conn', user_id,
  '","msg":"Slow query","attr":{{"type":"', operation, '","ns":"', COALESCE(namespace, '-'), '","command":{{"', operation, '":"c","filter":{{"p', user_id % 9, '":{{"$gt":5}},"a":["x\\\\"y{{",null]}},"q":{{"p', user_id % 9, '":{{"$gt":{{"$numberLong":"5"}}}},"a":[1,2.5]}}}}',
  ',"originatingCommand":{{"filter":{{"a":[true,{{"$oid":"1"}}],"p', user_id % 9, '":{{"$gt":"s"}}}}}}', COALESCE(CONCAT(',"durationMillis":', duration_ms), ''), COALESCE(CONCAT(',"cpuNanos":"', cpu_nanos, '"'), ''), COALESCE(CONCAT(',"reslen":', response_len, '.0'), ''),
  COALESCE(CONCAT(',"planSummary":"', plan_summary, '"'), ''), COALESCE(CONCAT(',"remote":"', remote, ':', user_id + 1, '"'), ''), '}}}}') AS raw_line"""
_PARSED = ["file_index", "line_number", "status", "error_code", "ts_ms", "severity", "component", "message_id", "context", "namespace", "operation", "duration_ms", "cpu_nanos", "response_len", "plan_summary", "remote", "query_pattern"]
add(
    "o20_parse_structured", "entries", lambda e: logs.entries(e.selectExpr("file_index", "line_number", _JSON)).select(*_PARSED),
    """SELECT file_index, line_number, CASE WHEN duration_ms IS NULL THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN duration_ms IS NULL THEN 'MISSING_SLOW_QUERY_DURATION' END AS error_code, ts_ms, COALESCE(severity, '-') AS severity,
    COALESCE(component, '-') AS component, COALESCE(message_id, 7) AS message_id, CONCAT('conn', user_id) AS context, COALESCE(namespace, '-') AS namespace, operation, duration_ms, cpu_nanos, response_len, plan_summary, remote,
    CONCAT('{"a":["?","?"],"p', user_id % 9, '":{"$gt":"?"}}') AS query_pattern FROM entries""",
)
_SHELL = f"""CONCAT({_iso("ts_ms", "yyyy-MM-dd''T''HH:mm:ss.SSS")}, '+0000 I COMMAND  [conn', user_id, '] command db.c', user_id % 7, ' command: find {{ find: "c", filter: {{ p', user_id % 9, ': ObjectId("a)b"), a: [ 1, new Date(5), "{{k: 1}}" ] }}, $db: "db" }} planSummary: IDHACK reslen:', COALESCE(response_len, 0), COALESCE(CONCAT(' ', duration_ms, 'ms'), '')) AS raw_line"""
add(
    "o28_parse_single_line", "entries", lambda e: logs.entries(e.selectExpr("file_index", "line_number", _SHELL)).select(*[c for c in _PARSED if c not in ("message_id", "cpu_nanos", "remote")]),
    """SELECT file_index, line_number, CASE WHEN duration_ms IS NULL THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN duration_ms IS NULL THEN 'MISSING_SLOW_QUERY_DURATION' END AS error_code, ts_ms, 'I' AS severity, 'COMMAND' AS component,
    CONCAT('conn', user_id) AS context, CONCAT('db.c', user_id % 7) AS namespace, 'find' AS operation, duration_ms, COALESCE(response_len, 0) AS response_len, 'IDHACK' AS plan_summary, CONCAT('{"a":["?","?","?"],"p', user_id % 9, '":"?"}') AS query_pattern FROM entries""",
)
_CASES = "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'no log' WHEN 3 THEN '{bad' WHEN 4 THEN '{\"a\":1}' WHEN 5 THEN '2025-03-10T14:14:17.729+0800 broken' WHEN 6 THEN '2025-93-10T14:14:17.729+0800 I X [a] b' WHEN 7 THEN '{\"t\":{\"$date\":\"2024-06-01T10:15:30Z\"},\"x\":9223372036854775808}' ELSE '{\"t\":{\"$date\":\"2024-06-01T10:15:30Z\"},\"msg\":\"Slow query\",\"attr\":{\"durationMillis\":1.5}}' END"
Q["o34_parse_outcomes"] = lambda spark, sf_dir: logs.entries(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("0 AS file_index", "event_id AS line_number", f"{_CASES} AS raw_line")).groupBy("status", "error_code").agg(F.count("*").alias("n"))
SQL["o34_parse_outcomes"] = """SELECT CASE WHEN event_id % 9 < 3 THEN 'SKIPPED' WHEN event_id % 9 = 8 THEN 'PARTIAL' ELSE 'FAILED' END AS status, CASE event_id % 9 WHEN 0 THEN 'EMPTY_LINE' WHEN 1 THEN 'EMPTY_LINE' WHEN 2 THEN 'NOT_MONGODB_LOG' WHEN 3 THEN 'INVALID_STRUCTURED_JSON'
  WHEN 4 THEN 'MISSING_TIMESTAMP' WHEN 5 THEN 'INVALID_LEGACY_HEADER' WHEN 6 THEN 'INVALID_TIMESTAMP' WHEN 7 THEN 'INVALID_STRUCTURED_JSON' ELSE 'INVALID_SLOW_QUERY_DURATION' END AS error_code, COUNT(*) AS n FROM events GROUP BY 1, 2"""
_HOST = "CASE event_id % 5 WHEN 0 THEN CONCAT('[::', user_id, ']:', event_id) WHEN 1 THEN CONCAT('h', user_id, ':', event_id) WHEN 2 THEN CONCAT('fe80::', user_id) WHEN 3 THEN ' ' ELSE CONCAT('h', user_id, ':x') END"
Q["o24_remote_hosts"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_HOST} AS a").select("event_id", host_of(F.col("a")).alias("host"))
SQL["o24_remote_hosts"] = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CONCAT('::', user_id) WHEN 1 THEN CONCAT('h', user_id) WHEN 2 THEN CONCAT('fe80::', user_id) WHEN 3 THEN NULL ELSE CONCAT('h', user_id, ':x') END AS host FROM events"
_NUMBER = "CASE event_id % 8 WHEN 0 THEN CONCAT(event_id, '.0') WHEN 1 THEN CONCAT(event_id, '.5') WHEN 2 THEN CONCAT('\"', event_id, '\"') WHEN 3 THEN CONCAT('\"', event_id, '.0\"') WHEN 4 THEN CONCAT('-', event_id + 1) WHEN 5 THEN CONCAT('{\"$numberLong\":\"', event_id, '\"}') WHEN 6 THEN '{\"$numberDouble\":\"NaN\"}' ELSE 'true' END"
Q["o22_whole_numbers"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"parse_json({_NUMBER}) AS v").select("event_id", exact_long(F.col("v")).alias("exact"), count_of(F.col("v")).alias("count_value"))
SQL["o22_whole_numbers"] = "SELECT event_id, CASE WHEN event_id % 8 IN (0, 2, 5) THEN event_id END AS exact, CASE WHEN event_id % 8 IN (0, 1, 5) THEN event_id WHEN event_id % 8 = 6 THEN 0 END AS count_value FROM events"
_SHAPE = "CASE event_id % 4 WHEN 0 THEN CONCAT('{\"z\":', event_id, ',\"b', user_id, '\":[null,{\"$oid\":\"x\"}]}') WHEN 1 THEN NULL WHEN 2 THEN '[{\"$match\":{\"s\":\"q\"}}]' ELSE '{\"n\":{\"m\":{\"$date\":{\"$numberLong\":\"5\"}}}}' END"
Q["o27_query_shapes"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_SHAPE} AS d").select("event_id", query_shape(F.col("d")).alias("shape"))
SQL["o27_query_shapes"] = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CONCAT('{"b', user_id, '":["?","?"],"z":"?"}') WHEN 1 THEN '{}' WHEN 2 THEN '[{"$match":{"s":"?"}}]' ELSE '{"n":{"m":"?"}}' END AS shape FROM events"""


def _all_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of every file, written as capture files (one for each file and day, in memory) and decoded again.

    Beside each series stands one that tells where it has a value (1), a null (2) or nothing (0)."""
    import numpy as np
    import pandas as pd

    first = F.struct("block_start", "block_ordinal", "point_idx")
    one = frame(spark, sf_dir, "samples").groupBy("file_id", "path", "ts_ms").agg(F.min_by(F.struct("value"), first)["value"].alias("value"))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, row = np.unique(pdf["ts_ms"], return_inverse=True)
        paths, col = np.unique(pdf["path"].astype(object), return_inverse=True)
        values, held = np.zeros((2, len(paths), len(ts)), np.int64)
        values[col, row], held[col, row] = pdf["value"], pdf["held"]
        names = ["start", *(f"value/{p}" for p in paths), *(f"held/{p}" for p in paths)]
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "content": [capture.encode_block(names, np.concatenate([ts[None], values, held]))]})

    points = one.select("file_id", "path", "ts_ms", F.coalesce("value", F.lit(0)).alias("value"), F.when(F.col("value").isNull(), 2).otherwise(1).alias("held"))
    files = points.withColumn("day", F.floor(F.col("ts_ms") / 86_400_000)).groupBy("file_id", "day").applyInPandas(encode, "file_id int, content binary")
    back = capture.samples_of(files).where("path <> 'start'").withColumn("of", F.regexp_replace("path", "^(value|held)/", ""))
    kind = F.col("path").startswith("held/")
    both = back.groupBy("file_id", F.col("of").alias("path"), "ts_ms").agg(F.max(F.when(~kind, F.col("value"))).alias("value"), F.max(F.when(kind, F.col("value"))).alias("held"))
    return both.where("held > 0").select("file_id", "path", "ts_ms", F.when(F.col("held") == 1, F.col("value")).alias("value"))


Q["o04_capture_round_trip"] = _all_captured
SQL["o04_capture_round_trip"] = duck("samples") + "SELECT file_id, path, ts_ms, FIRST(value ORDER BY block_start, block_ordinal, point_idx) AS value FROM samples GROUP BY 1, 2, 3"
_paths = ", l AS (SELECT file_id, block_ordinal, LIST(DISTINCT path ORDER BY path) AS ps FROM samples GROUP BY 1, 2), f AS (SELECT ps, MIN(ROW(file_id, block_ordinal)) AS seen FROM l GROUP BY 1), i AS (SELECT ps, ROW_NUMBER() OVER (ORDER BY seen) - 1 AS id FROM f), u AS (SELECT id, UNNEST(ps) AS path FROM i)"


def _schemas(s: DataFrame) -> DataFrame:
    return S.schemas_of(s.groupBy("file_id", "block_ordinal").agg(F.sort_array(F.collect_set("path")).alias("paths")))


add("o50_path_schemas", "samples", lambda s: S.path_schemas(_schemas(s)).select("path", "metric_id", F.array_join(F.col("schema_ids").cast("array<string>"), ",").alias("schema_ids")), f"{_paths} SELECT path, SUBSTR(SHA256(path), 1, 16) AS metric_id, STRING_AGG(CAST(id AS VARCHAR), ',' ORDER BY id) AS schema_ids FROM u GROUP BY 1")
_listed = ", l AS (SELECT file_id, block_ordinal, LIST(DISTINCT path ORDER BY path) AS ps FROM samples GROUP BY 1, 2)"


def _block_paths(s: DataFrame) -> DataFrame:
    return s.groupBy("file_id", "block_ordinal").agg(F.sort_array(F.collect_set("path")).alias("paths"))


add("o48_blocks_of_metrics", "samples", lambda s: S.blocks_of_metrics(_block_paths(s), S.kept_paths(s)), f"{_listed} SELECT * FROM (SELECT file_id, block_ordinal, UNNEST(ps) AS path, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS position FROM l) x WHERE path NOT IN ('" + "', '".join(S.EXCLUDED) + "')")
add("o99_paths", "samples", lambda s: S.paths_in_order(_schemas(s)), f"{_listed}, f AS (SELECT ps, MIN(ROW(file_id, block_ordinal)) AS seen FROM l GROUP BY 1), i AS (SELECT ps, ROW_NUMBER() OVER (ORDER BY seen) - 1 AS id FROM f), u AS (SELECT id, UNNEST(ps) AS path, generate_subscripts(ps, 1) AS pos FROM i), g AS (SELECT path, MIN(ROW(id, pos)) AS seen FROM u GROUP BY 1) SELECT ROW_NUMBER() OVER (ORDER BY seen) - 1 AS place, path FROM g")

from . import source_queries  # noqa: E402, F401  the queries of sources, parsers and stores join these
