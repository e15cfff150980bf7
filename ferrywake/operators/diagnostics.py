"""Operational diagnostics: events, replication, timelines, efficiency signals, data quality.

The functions take entries with flat diagnostic columns; `diagnostic_columns` derives them from parsed
entries, so the aggregations never carry documents through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank, or_unknown, redacted
from ..functions.values import HOUR, at, average, count_of, floor_to, kind_of, ratio
from .summary import present

# Limits of the diagnostic lists.
EVENT_KEYS, REPLICATION_KEYS, INSIGHTS, SHAPES, TIMELINE_POINTS, SAMPLES, TOP_NAMES = 500, 100, 50, 10_000, 2_000, 3, 20
CAPACITY = {"service": 20, "server_version": 20, "application": 100, "driver": 100, "query_framework": 50}


def diagnostic_columns(entries: DataFrame) -> DataFrame:
    """entries (of logs) with the flat columns that the functions here take, in place of the document."""
    a = F.col("attr")

    def text(path: str) -> Column:
        return at(a, path, "string")

    def given(path: str) -> Column:
        x = at(a, path)
        return x.isNotNull() & (kind_of(x) != "VOID")

    locks = at(a, "$.locks", "map<string,variant>")
    waits = F.flatten(F.transform(F.map_values(locks), lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$.timeAcquiringMicros", "map<string,variant>")), F.array().cast("array<variant>"))))
    queues = F.transform(F.map_values(at(a, "$.queues", "map<string,variant>")), lambda v: F.try_variant_get(v, "$.totalTimeQueuedMicros", "variant"))

    def total(values: Column) -> Column:
        return F.coalesce(F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + F.coalesce(count_of(v), F.lit(0))), F.lit(0).cast("bigint"))

    fields = at(a, "$", "map<string,variant>")

    def ending(suffix: str) -> Column:
        return total(F.map_values(F.map_filter(fields, lambda k, _: F.endswith(k, F.lit(suffix)))))

    meta = F.lower("message") == "client metadata"
    driver = F.concat_ws(" ", text("$.doc.driver.name"), text("$.doc.driver.version"))
    return entries.withColumns(
        {
            "legacy": F.col("envelope").isNull(),
            "service": F.col("envelope.service"),
            "truncated": F.coalesce(F.col("envelope.truncated"), F.lit(False)),
            "tagged": F.coalesce(F.size("envelope.tags") > 0, F.lit(False)),
            "server_version": text("$.buildInfo.version"),
            "connection_count": count_of(at(a, "$.connectionCount")),
            "application": F.when(meta, text("$.doc.application.name")),
            "driver": F.when(meta & text("$.doc.driver.name").isNotNull(), driver),
            "docs_examined": count_of(at(a, "$.docsExamined")),
            "keys_examined": count_of(at(a, "$.keysExamined")),
            "returned": count_of(at(a, "$.nreturned")),
            "storage_micros": count_of(at(a, "$.storage.data.timeReadingMicros")),
            "planning_micros": count_of(at(a, "$.planningTimeMicros")),
            "write_concern_ms": count_of(at(a, "$.waitForWriteConcernDurationMillis")),
            "flow_control_micros": count_of(at(a, "$.flowControl.timeAcquiringMicros")),
            "remote_wait_ms": count_of(at(a, "$.remoteOpWaitMillis")),
            "authorization_micros": count_of(at(a, "$.authorization.userCacheWaitTimeMicros")),
            "oplog_slot_micros": count_of(at(a, "$.totalOplogSlotDurationMicros")),
            "lock_micros": total(waits),
            "queue_micros": total(queues),
            "spilled_bytes": ending("SpilledBytes"),
            "spilled_records": ending("SpilledRecords"),
            "spills": ending("Spills"),
            "has_sort": F.coalesce((kind_of(at(a, "$.hasSortStage")) == "BOOLEAN") & at(a, "$.hasSortStage", "boolean"), F.lit(False)),
            "used_disk": F.coalesce((kind_of(at(a, "$.usedDisk")) == "BOOLEAN") & at(a, "$.usedDisk", "boolean"), F.lit(False)),
            "query_hash": text("$.queryHash"),
            "plan_cache_key": text("$.planCacheKey"),
            "plan_shape_hash": text("$.planCacheShapeHash"),
            "query_shape_hash": text("$.queryShapeHash"),
            "query_framework": text("$.queryFramework"),
            "bytes_read": text("$.storage.data.bytesRead"),
            "has_flow_control": given("$.flowControl"),
            "has_locks": given("$.locks"),
            "has_queues": given("$.queues"),
            "working_ms": text("$.workingMillis"),
            "plan_summary": F.coalesce("plan_summary", text("$.planSummary")),
        }
    ).drop("attr", "envelope")


def slow_rows(entries: DataFrame) -> DataFrame:
    return present(entries).where(F.col("is_slow") & F.col("duration_ms").isNotNull())


def severities(entries: DataFrame) -> DataFrame:
    """Counts of severities and components, in one pass."""
    rows = present(entries).select(F.explode(F.array(F.struct(F.lit("severity").alias("kind"), or_unknown(F.col("severity")).alias("value")), F.struct(F.lit("component").alias("kind"), or_unknown(F.col("component")).alias("value")))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "value")


def quality(entries: DataFrame) -> DataFrame:
    return present(entries).agg(
        F.count_if(~F.col("legacy")).alias("structured"), F.count_if("legacy").alias("legacy"), F.count_if(~F.col("legacy") & F.col("truncated")).alias("truncated"), F.count_if(~F.col("legacy") & F.col("tagged")).alias("tagged")
    )


def out_of_order(entries: DataFrame) -> DataFrame:
    """Entries of each file that are older than the entry before them.

    The order is that of a whole file, so files are cut into ranges of lines; each range is compared in itself and
    with the last entry before it, which keeps a task to a range."""
    rows = present(entries).select("file_index", "line_number", "ts_ms", F.floor(F.col("line_number") / 1_000_000).alias("part"))
    inside = Window.partitionBy("file_index", "part").orderBy("line_number")
    late = rows.withColumn("late", F.col("ts_ms") < F.lag("ts_ms").over(inside))
    ends = rows.groupBy("file_index", "part").agg(F.min_by("ts_ms", "line_number").alias("first_ts"), F.max_by("ts_ms", "line_number").alias("last_ts"))
    across = ends.withColumn("late", F.col("first_ts") < F.lag("last_ts").over(Window.partitionBy("file_index").orderBy("part")))
    both = late.select("file_index", "late").union(across.select("file_index", "late"))
    return both.groupBy("file_index").agg(F.count_if("late").alias("out_of_order")).orderBy("file_index")


def frequent_names(entries: DataFrame, limit: int = TOP_NAMES) -> DataFrame:
    """The most frequent services, versions, applications, drivers and frameworks, exactly; `approximate` says that there
    are more of a kind than a bounded counter would hold."""
    slow = F.col("is_slow") & F.col("duration_ms").isNotNull()
    values = {"service": F.col("service"), "server_version": F.col("server_version"), "application": F.col("application"), "driver": F.col("driver"), "query_framework": F.when(slow, F.col("query_framework"))}
    rows = present(entries).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])).alias("x"))
    counts = rows.where(F.trim("x.value") != "").groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    capacity = F.create_map(*[F.lit(x) for kv in CAPACITY.items() for x in kv])
    distinct = counts.groupBy("kind").agg(F.count("*").alias("d"))  # five rows
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    out = counts.withColumn("place", rank).where(F.col("place") <= limit).join(F.broadcast(distinct), "kind")
    return out.select("kind", "value", "n", (F.col("d") > capacity[F.col("kind")]).alias("approximate")).orderBy("kind", F.desc("n"), "value")


def shapes(entries: DataFrame, cap: int = SHAPES) -> DataFrame:
    shape = non_blank(F.col("plan_shape_hash"), F.col("query_hash"), F.col("query_pattern"))
    return slow_rows(entries).agg(F.least(F.countDistinct(shape), F.lit(cap)).cast("bigint").alias("shapes"))


def _events(rows: DataFrame, key: Column, cap: int, samples: int) -> DataFrame:
    """Events by key: the first `cap` keys to arrive, each with its first entry's fields and its first messages."""
    order = F.struct("file_index", "line_number")
    keyed = rows.withColumn("key", key)
    stats = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.min(order).alias("arrived"), F.min_by(F.struct("severity", "component", "message_id", "message"), order).alias("head")
    )
    kept = stats.orderBy("arrived").limit(cap)
    if not samples:
        return kept
    # the rank limit is applied in each task before the exchange (WindowGroupLimit), so no key is gathered whole
    rank = F.row_number().over(Window.partitionBy("key").orderBy("file_index", "line_number"))
    first = keyed.select("key", "file_index", "line_number", "ts_ms", "message").withColumn("i", rank).where(F.col("i") <= samples)
    listed = first.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "ts_ms", redacted(F.col("message")).alias("message")))), lambda s: F.struct(s["ts_ms"].alias("ts_ms"), s["message"].alias("message"))).alias("samples"))
    return kept.join(listed, "key")


def event_key(prefix: Column) -> Column:
    """The prefix with the message id, or with the redacted message where there is none."""
    return F.concat_ws("|", prefix, F.coalesce(F.col("message_id").cast("string"), redacted(or_unknown(F.col("message")))))


def abnormal(entries: DataFrame) -> DataFrame:
    """Warnings, errors and fatal entries by component and message."""
    rows = present(entries).where(or_unknown(F.col("severity")).rlike("^[WEF]"))
    found = _events(rows, event_key(or_unknown(F.col("component"))), EVENT_KEYS, SAMPLES)
    return found.select("key", "head.severity", "head.component", "head.message_id", redacted(F.col("head.message")).alias("message"), "n", "first_ms", "last_ms", "samples").orderBy(F.desc("n"), "key")


def event_list(events: DataFrame) -> DataFrame:
    """Events (of abnormal() or replication(), at most some hundred) with their places: the most frequent first, then by key."""
    return events.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "key")).cast("bigint"))


def is_accepted() -> Column:
    m = F.lower(F.coalesce("message", F.lit("")))
    return (m == "connection accepted") | m.startswith("connection accepted from")


def is_ended() -> Column:
    m = F.lower(F.coalesce("message", F.lit("")))
    return (m == "connection ended") | m.startswith("end connection")


def connections(entries: DataFrame) -> DataFrame:
    m, c = F.lower(F.coalesce("message", F.lit(""))), F.col("connection_count")
    return present(entries).agg(
        F.count_if(is_accepted()).alias("accepted"),
        F.count_if(is_ended()).alias("ended"),
        F.count_if(m == "successfully authenticated").alias("authenticated"),
        F.count_if(m == "connection not authenticating").alias("not_authenticating"),
        F.count_if(F.contains(m, F.lit("attempted to reauthenticate"))).alias("reauthentications"),
        F.count(c).alias("samples"),
        F.min(c).alias("min_connections"),
        F.max(c).alias("max_connections"),
        average(F.sum(c), F.count(c)).alias("avg_connections"),
    )


# Kinds of replication events, by parts of the message, the first that applies.
REPLICATION = (
    ("HEARTBEAT_FAILURE", ("heartbeat failed",)),
    ("HOST_UNAVAILABLE", ("host failed in replica set",)),
    ("TOPOLOGY_CHANGE", ("topology change", "primary server change")),
    ("MEMBER_STATE_CHANGE", ("member is in new state", "state transition")),
    ("ELECTION", ("election", "takeover")),
    ("SYNC_SOURCE", ("sync source",)),
    ("SLOW_CONNECTION", ("slow connection establishment",)),
    ("SOCKET_FAILURE", ("socket connectivity",)),
)


def replication_kind() -> Column:
    m = F.lower(F.coalesce("message", F.lit("")))
    out = None
    for kind, parts in REPLICATION:
        hit = F.lit(False)
        for p in parts:
            hit |= F.contains(m, F.lit(p))
        if kind == "ELECTION":
            hit |= F.upper(F.coalesce("component", F.lit(""))) == "ELECTION"
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def replication(entries: DataFrame) -> DataFrame:
    rows = present(entries).withColumn("kind", replication_kind()).where("kind IS NOT NULL")
    found = _events(rows, event_key(F.col("kind")), REPLICATION_KEYS, 0)
    return found.select("key", F.split_part("key", F.lit("|"), F.lit(1)).alias("kind"), "head.component", "head.message_id", redacted(F.col("head.message")).alias("message"), "n", "first_ms", "last_ms").orderBy(F.desc("n"), "key")


TIMELINE = ("warnings", "errors", "fatals", "accepted", "ended", "replication")


def timeline(entries: DataFrame, max_points: int = TIMELINE_POINTS) -> DataFrame:
    """Six counts by time, in hours doubled until at most `max_points` buckets have any."""
    s = or_unknown(F.col("severity"))
    flags = (s.startswith("W"), s.startswith("E"), s.startswith("F"), is_accepted(), is_ended(), replication_kind().isNotNull())
    rows = present(entries).select(floor_to(F.col("ts_ms"), HOUR).alias("hour_ms"), *[f.cast("bigint").alias(n) for f, n in zip(flags, TIMELINE)])
    hours = rows.where(" + ".join(TIMELINE) + " > 0").groupBy("hour_ms").agg(*[F.sum(n).alias(n) for n in TIMELINE])
    # the first width that is wide enough, by distinct buckets of the hours
    widths = F.array(*[F.lit(HOUR << k).cast("bigint") for k in range(31)])
    buckets = hours.select("hour_ms", F.explode(widths).alias("w")).select("w", F.floor(F.col("hour_ms") / F.col("w")).alias("b")).distinct()
    width = buckets.groupBy("w").agg(F.count("*").alias("d")).where(F.col("d") <= max_points).agg(F.coalesce(F.min("w"), F.lit(HOUR)).alias("width_ms"))
    out = hours.crossJoin(F.broadcast(width))  # one row
    return out.groupBy("width_ms", floor_to(F.col("hour_ms"), F.col("width_ms")).alias("bucket_ms")).agg(*[F.sum(n).cast("bigint").alias(n) for n in TIMELINE]).orderBy("bucket_ms")


def timeline_series(points: DataFrame) -> DataFrame:
    return points.unpivot("bucket_ms", list(TIMELINE), "series", "n").orderBy("series", "bucket_ms")


def signals() -> dict[str, Column]:
    """The sixteen efficiency predicates of a slow query."""
    c, d = F.col, F.col("duration_ms")

    def true(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    return {
        "collscan": true(F.contains("plan_summary", F.lit("COLLSCAN"))),
        "high_docs_ratio": true((c("returned") > 0) & (c("docs_examined") / c("returned") >= 100)),
        "high_keys_ratio": true((c("returned") > 0) & (c("keys_examined") / c("returned") >= 100)),
        "zero_return_scan": true((c("returned") == 0) & (c("docs_examined") >= 1000)),
        "storage_dominant": true(c("storage_micros") >= d * 500.0),
        "planning_dominant": true(c("planning_micros") >= d * 500.0),
        "write_concern_wait": true(c("write_concern_ms") > 0),
        "flow_control_wait": true(c("flow_control_micros") > 0),
        "lock_wait": true(c("lock_micros") > 0),
        "remote_wait": true(c("remote_wait_ms") > 0),
        "authorization_wait": true(c("authorization_micros") > 0),
        "queue_wait": true(c("queue_micros") > 0),
        "oplog_slot_wait": true(c("oplog_slot_micros") > 0),
        "sort_stage": true(c("has_sort")),
        "used_disk": true(c("used_disk")),
        "spilled": true((c("spills") > 0) | (c("spilled_bytes") > 0) | (c("spilled_records") > 0)),
    }


def signal_counts(entries: DataFrame) -> DataFrame:
    return slow_rows(entries).agg(F.count("*").alias("slow_total"), *[F.count_if(x).alias(n) for n, x in signals().items()])


def signal_table(entries: DataFrame) -> DataFrame:
    """A row for each of the signals."""
    return signal_counts(entries).unpivot([], list(signals()), "signal", "n")


def coverage_fields() -> dict[str, Column]:
    c = F.col
    return {
        "planSummary": c("plan_summary"), "docsExamined": c("docs_examined"), "keysExamined": c("keys_examined"), "nreturned": c("returned"), "queryHash": c("query_hash"), "planCacheKey": c("plan_cache_key"),
        "planCacheShapeHash": c("plan_shape_hash"), "queryShapeHash": c("query_shape_hash"), "planningTimeMicros": c("planning_micros"), "storage.data.bytesRead": c("bytes_read"),
        "storage.data.timeReadingMicros": c("storage_micros"), "flowControl": F.when(c("has_flow_control"), 1), "waitForWriteConcernDurationMillis": c("write_concern_ms"), "locks": F.when(c("has_locks"), 1),
        "queryFramework": c("query_framework"), "queues": F.when(c("has_queues"), 1), "workingMillis": c("working_ms"), "remoteOpWaitMillis": c("remote_wait_ms"),
        "authorization.userCacheWaitTimeMicros": c("authorization_micros"), "cpuNanos": c("cpu_nanos"), "totalOplogSlotDurationMicros": c("oplog_slot_micros"),
        "spilledBytes": F.when(c("spilled_bytes") > 0, 1), "spilledRecords": F.when(c("spilled_records") > 0, 1),
    }


def coverage(entries: DataFrame) -> DataFrame:
    """How many slow queries have each field; fields that none has are absent."""
    fields = coverage_fields()
    counts = slow_rows(entries).agg(*[F.count(x).alias(f"f{i}") for i, x in enumerate(fields.values())])
    names = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"f{i}").alias("n")) for i, n in enumerate(fields)])
    return counts.select(F.explode(names).alias("x")).select("x.field", "x.n").where("n > 0").orderBy(F.desc("n"), "field")


def insights(entries: DataFrame, limit: int = INSIGHTS) -> DataFrame:
    """Slow queries with signals: those with the most, then the slowest, then the latest."""
    reasons = F.array_compact(F.array(*[F.when(x, n) for n, x in signals().items()]))
    rows = slow_rows(entries).withColumn("reasons", reasons).where(F.size("reasons") > 0)
    top = rows.orderBy(F.desc(F.size("reasons")), F.desc("duration_ms"), F.desc("ts_ms"), "file_index", "line_number").limit(limit)
    return top.select(
        "file_index", "line_number", "ts_ms", "namespace", "operation", "query_pattern", non_blank(F.col("plan_shape_hash"), F.col("query_hash")).alias("shape_hash"), "plan_cache_key", "plan_summary",
        "duration_ms", "docs_examined", "keys_examined", "returned", ratio(F.col("docs_examined"), F.col("returned")).alias("docs_ratio"), ratio(F.col("keys_examined"), F.col("returned")).alias("keys_ratio"),
        (F.col("storage_micros") / 1000).alias("storage_ms"), (F.col("planning_micros") / 1000).alias("planning_ms"), "write_concern_ms", (F.col("flow_control_micros") / 1000).alias("flow_control_ms"),
        (F.col("lock_micros") / 1000).alias("lock_ms"), "reasons",
    )


def overview(entries: DataFrame) -> DataFrame:
    """Totals of abnormal and replication events, slow queries and those with signals, in one pass."""
    any_signal = F.lit(False)
    for x in signals().values():
        any_signal |= x
    slow = F.col("is_slow") & F.col("duration_ms").isNotNull()
    kind = replication_kind()
    return present(entries).agg(
        F.count_if(or_unknown(F.col("severity")).rlike("^[WEF]")).alias("abnormal"), F.count_if(kind.isNotNull()).alias("replication"), F.countDistinct(kind).alias("replication_kinds"),
        F.count_if(slow & any_signal).alias("with_signals"), F.count_if(slow).alias("slow_total"),
    )


def explanations(entries: DataFrame) -> DataFrame:
    """Per slow query: what its figures say, as rows of label, field and value."""
    c = F.col

    def line(label: str, field: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), F.lit(field).alias("field"), value.cast("string").alias("value")))

    per = F.array_compact(
        F.array(
            line("duration", "durationMillis", c("duration_ms")),
            line("plan", "planSummary", c("plan_summary")),
            line("documents examined", "docsExamined", F.when(~c("legacy"), c("docs_examined"))),
            line("keys examined", "keysExamined", F.when(~c("legacy"), c("keys_examined"))),
            line("returned", "nreturned", F.when(~c("legacy"), c("returned"))),
            line("documents per result", "docsExamined/nreturned", F.when(~c("legacy"), F.round(ratio(c("docs_examined"), c("returned")), 3))),
            line("response bytes", "reslen", c("response_len")),
            line("CPU ms", "cpuNanos", F.round(c("cpu_nanos") / 1e6, 3)),
            line("lock wait ms", "locks", F.when(c("lock_micros") > 0, c("lock_micros") / 1000)),
        )
    )
    found = F.array_compact(F.array(*[F.when(x, n) for n, x in signals().items()]))
    return slow_rows(entries).select(F.concat_ws("-", "file_index", "line_number").alias("query_id"), per.alias("rows"), found.alias("observations"))
