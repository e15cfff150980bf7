"""The tables that queries run on when the source is the `events` table: one SQL text for Spark and DuckDB.

Events stand for log entries (with unreadable lines, null and blank values, ties and zero durations) and for
metric samples (three captures that overlap, hours without samples, a metric that is zero throughout).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_TS = "unix_millis(CAST(ts AS TIMESTAMP))"
DUCK_TS = "(epoch_us(ts) // 1000)"
TEXT = "VARCHAR(20)"

ENTRIES = f"""
SELECT *, CASE WHEN message = 'client metadata' THEN CONCAT('app', CAST(user_id % 120 AS {TEXT})) END AS application,
  CASE WHEN message = 'client metadata' AND user_id % 9 <> 0 THEN CONCAT('driver ', CAST(user_id % 7 AS {TEXT})) END AS driver
FROM (
SELECT user_id, CAST(event_id % 3 AS INT) AS file_index, event_id AS line_number, @TS@ AS ts_ms,
  CASE WHEN event_id % 97 = 0 THEN 'FAILED' WHEN event_id % 89 = 0 THEN 'SKIPPED' WHEN event_id % 83 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 97 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'INVALID_STRUCTURED_JSON' ELSE 'MISSING_TIMESTAMP' END
    WHEN event_id % 89 = 0 THEN 'EMPTY_LINE' WHEN event_id % 83 = 0 THEN 'INVALID_SLOW_QUERY_METRICS' END AS error_code,
  CASE event_id % 41 WHEN 0 THEN 'W' WHEN 1 THEN 'E' WHEN 2 THEN 'F' WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE 'I' END AS severity,
  CASE user_id % 6 WHEN 0 THEN 'COMMAND' WHEN 1 THEN 'NETWORK' WHEN 2 THEN 'REPL' WHEN 3 THEN 'ELECTION' WHEN 4 THEN NULL ELSE 'WRITE' END AS component,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(20000 + event_id % 600 AS INT) END AS message_id,
  CASE event_id % 29 WHEN 0 THEN 'Connection accepted' WHEN 1 THEN CONCAT('connection accepted from host #7 (', CAST(event_id % 50 AS {TEXT}), ' connections now open)')
    WHEN 2 THEN 'Connection ended' WHEN 3 THEN 'end connection host' WHEN 4 THEN 'Successfully authenticated' WHEN 5 THEN 'Connection not authenticating'
    WHEN 6 THEN 'Client has attempted to reauthenticate as a single user' WHEN 7 THEN 'client metadata' WHEN 8 THEN 'Heartbeat failed after max retries'
    WHEN 9 THEN 'Host failed in replica set' WHEN 10 THEN 'Topology Change' WHEN 11 THEN 'Member is in new state' WHEN 12 THEN 'Starting an election'
    WHEN 13 THEN 'Sync source candidate chosen' WHEN 14 THEN 'Slow connection establishment' WHEN 15 THEN 'Checking socket connectivity' WHEN 16 THEN NULL
    ELSE 'Slow query' END AS message,
  CASE user_id % 37 WHEN 5 THEN NULL WHEN 6 THEN '  ' ELSE CONCAT('db.c', CAST(user_id % 37 AS {TEXT})) END AS namespace,
  CASE event_type WHEN 'click' THEN 'find' WHEN 'view' THEN 'getMore' WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'update' ELSE 'remove' END AS operation,
  CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 0 ELSE CAST(FLOOR(value * 200) AS BIGINT) END AS duration_ms,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id * 7919 % 90000000 END AS cpu_nanos,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id * 37 % 10000 END AS response_len,
  CASE user_id % 4 WHEN 0 THEN 'COLLSCAN' WHEN 1 THEN CONCAT('IXSCAN x', CAST(user_id % 12 AS {TEXT})) WHEN 2 THEN NULL ELSE 'IDHACK' END AS plan_summary,
  CASE WHEN user_id % 23 = 4 THEN NULL ELSE CONCAT('10.0.0.', CAST(user_id % 23 AS {TEXT})) END AS remote,
  CONCAT('p', CAST(event_id * 31 % 113 AS {TEXT})) AS query_pattern,
  event_id % 19 <> 0 AS is_slow, event_id % 29 = 8 AS heartbeat_failure, event_id % 11 = 0 AS legacy,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN ' ' ELSE CONCAT('S', CAST(user_id % 3 AS {TEXT})) END AS service,
  event_id % 53 = 0 AS truncated, event_id % 47 = 0 AS tagged,
  CASE WHEN event_id % 31 = 0 THEN CONCAT('7.0.', CAST(user_id % 30 AS {TEXT})) END AS server_version,
  CASE WHEN event_id % 13 = 0 THEN event_id % 200 END AS connection_count,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id * 13 % 5000 END AS docs_examined,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id * 11 % 3000 END AS keys_examined,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 40 END AS returned,
  CASE WHEN event_id % 4 = 0 THEN event_id * 997 % 60000000 END AS storage_micros, CASE WHEN event_id % 10 = 3 THEN event_id * 991 % 60000000 END AS planning_micros,
  CASE WHEN event_id % 14 = 1 THEN event_id % 3 END AS write_concern_ms, CASE WHEN event_id % 15 = 2 THEN event_id % 4 END AS flow_control_micros,
  CASE WHEN event_id % 16 = 3 THEN event_id % 5 END AS remote_wait_ms, CASE WHEN event_id % 18 = 4 THEN event_id % 6 END AS authorization_micros,
  CASE WHEN event_id % 20 = 5 THEN event_id % 3 END AS oplog_slot_micros,
  CASE WHEN event_id % 21 = 6 THEN event_id % 1000 ELSE 0 END AS lock_micros, CASE WHEN event_id % 22 = 7 THEN event_id % 1000 ELSE 0 END AS queue_micros,
  CASE WHEN event_id % 23 = 8 THEN event_id % 500 ELSE 0 END AS spilled_bytes, CASE WHEN event_id % 24 = 9 THEN event_id % 50 ELSE 0 END AS spilled_records,
  CASE WHEN event_id % 25 = 10 THEN 1 ELSE 0 END AS spills, event_id % 26 = 11 AS has_sort, event_id % 27 = 12 AS used_disk,
  CASE WHEN event_id % 3 = 0 THEN CONCAT('q', CAST(event_id % 700 AS {TEXT})) END AS query_hash, CASE WHEN event_id % 12 = 0 THEN CONCAT('k', CAST(event_id % 90 AS {TEXT})) END AS plan_cache_key,
  CASE WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE CONCAT('s', CAST(event_id % 300 AS {TEXT})) END END AS plan_shape_hash,
  CASE WHEN event_id % 28 = 0 THEN 'x' END AS query_shape_hash, CASE WHEN event_id % 3 = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'classic' ELSE 'sbe' END END AS query_framework,
  CASE WHEN event_id % 30 = 0 THEN '1' END AS bytes_read, event_id % 15 = 2 AS has_flow_control, event_id % 21 = 6 AS has_locks, event_id % 22 = 7 AS has_queues,
  CASE WHEN event_id % 32 = 0 THEN '5' END AS working_ms
FROM @EVENTS@) e
"""

SLOW = f"SELECT *, CONCAT(CAST(file_index AS {TEXT}), '-', CAST(line_number AS {TEXT})) AS query_id FROM entries WHERE status IN ('SUCCESS', 'PARTIAL') AND is_slow AND duration_ms IS NOT NULL"

SAMPLES = f"""
SELECT path, CAST(event_id % 3 AS INT) AS file_id, CAST(FLOOR(ms / 3600000) * 3600000 AS BIGINT) AS block_start, CAST(FLOOR(ms / 3600000) % 100000 AS INT) AS block_ordinal,
  CAST(event_id AS INT) AS point_idx, CAST(FLOOR(ms / 60000) * 60000 AS BIGINT) AS ts_ms, CASE WHEN path LIKE '%/zero' THEN 0 ELSE CAST(FLOOR(value * 100) AS BIGINT) END AS value
FROM (SELECT event_id, value, @TS@ AS ms, CASE user_id % 6 WHEN 0 THEN CONCAT('serverStatus/opcounters/', event_type) WHEN 1 THEN CONCAT('systemMetrics/netstat/TcpExt/', event_type)
  WHEN 2 THEN 'start' WHEN 3 THEN CONCAT('serverStatus/wiredTiger/cache/bytes ', event_type) WHEN 4 THEN 'serverStatus/metrics/zero' ELSE 'flat' END AS path FROM @EVENTS@) s
WHERE FLOOR(ms / 3600000) % 7 <> 3
"""

BLOCKS = """
SELECT file_id, block_ordinal, CAST(COUNT(*) - 1 AS INT) AS num_deltas, MIN(ts_ms) AS start_ms, MAX(ts_ms) AS end_ms FROM samples GROUP BY file_id, block_ordinal
"""


def duck(*tables: str) -> str:
    """WITH clause of the named tables (and what they need) for DuckDB."""
    parts = {"entries": ENTRIES, "slow": SLOW, "samples": SAMPLES, "blocks": BLOCKS}
    needs = {"slow": ["entries"], "blocks": ["samples"]}
    names: list[str] = []
    for t in tables:
        names += [x for x in [*needs.get(t, []), t] if x not in names]
    return "WITH " + ", ".join(f"{n} AS ({parts[n].replace('@TS@', DUCK_TS).replace('@EVENTS@', 'events')})" for n in names) + " "


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    text = {"entries": ENTRIES, "slow": ENTRIES, "samples": SAMPLES, "blocks": SAMPLES}[name]
    base = spark.sql(text.replace("@TS@", SPARK_TS).replace("@EVENTS@", "{events}"), events=events)
    if name == "slow":
        return spark.sql(SLOW.replace("FROM entries", "FROM {entries}"), entries=base)
    if name == "blocks":
        return spark.sql(BLOCKS.replace("FROM samples", "FROM {samples}"), samples=base)
    return base
