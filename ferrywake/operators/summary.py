"""The fixed report over slow queries: aggregates, histograms, rankings, pages.

All take the frames of `logs` (or any with the same columns) and return small frames. Averages come from
whole sums divided once, so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_text, or_unknown
from ..functions.values import HOUR, average, floor_to

# The duration buckets, [low, high) in milliseconds.
BUCKETS = (
    ("lt_100ms", "< 100ms", 0, 100),
    ("100ms_500ms", "100ms - 500ms", 100, 500),
    ("500ms_1s", "500ms - 1s", 500, 1_000),
    ("1s_3s", "1s - 3s", 1_000, 3_000),
    ("3s_10s", "3s - 10s", 3_000, 10_000),
    ("10s_30s", "10s - 30s", 10_000, 30_000),
    ("30s_60s", "30s - 60s", 30_000, 60_000),
    ("gte_60s", ">= 60s", 60_000, None),
)
# Operations of the CPU ratio histogram, the limits of the rankings, and the connection message.
CPU_OPERATIONS = ("insert", "update", "delete", "find")
TOP_GROUPS, TOP_PATTERNS, TOP_QUERIES = 20, 50, 5000
CONNECTIONS_OPEN = r"\((\d+) connections now open\)"
STAT = ("n", "total_ms", "avg_ms", "min_ms", "max_ms", "response_bytes", "cpu_nanos")


def stat_columns() -> list[Column]:
    total, n = F.sum("duration_ms"), F.count("*")
    return [
        n.alias("n"),
        total.cast("bigint").alias("total_ms"),
        average(total, n).alias("avg_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum(F.coalesce("response_len", F.lit(0))).cast("bigint").alias("response_bytes"),
        F.sum(F.coalesce("cpu_nanos", F.lit(0))).cast("bigint").alias("cpu_nanos"),
    ]


def by(slow: DataFrame, key: Column, name: str) -> DataFrame:
    """The common aggregate of each value of a key, blank values as `unknown`."""
    return slow.groupBy(or_unknown(key).alias(name)).agg(*stat_columns())


def most_frequent(stats: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    out = stats.orderBy(F.desc("n"), F.asc(key))
    return out.limit(limit) if limit else out


def most_bytes(stats: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    out = stats.orderBy(F.desc("response_bytes"), F.desc("n"), F.asc(key))
    return out.limit(limit) if limit else out


def by_operation(slow: DataFrame) -> DataFrame:
    return most_frequent(by(slow, F.col("operation"), "operation"), "operation")


def by_namespace(slow: DataFrame, limit: int | None = TOP_GROUPS) -> DataFrame:
    return most_bytes(by(slow, F.col("namespace"), "namespace"), "namespace", limit)


def by_pattern(slow: DataFrame, limit: int | None = TOP_PATTERNS) -> DataFrame:
    return most_frequent(by(slow, F.col("query_pattern"), "query_pattern"), "query_pattern", limit)


def by_plan(slow: DataFrame) -> DataFrame:
    return most_frequent(by(slow, F.col("plan_summary"), "plan_summary"), "plan_summary")


def by_remote(slow: DataFrame, limit: int | None = TOP_GROUPS) -> DataFrame:
    return most_bytes(by(slow, F.col("remote"), "remote"), "remote", limit)


def cpu_by_operation_namespace(slow: DataFrame) -> DataFrame:
    key = F.concat_ws("|", or_unknown(F.col("operation")), or_unknown(F.col("namespace")))
    return most_frequent(slow.where(F.col("cpu_nanos").isNotNull()).groupBy(key.alias("operation_namespace")).agg(*stat_columns()), "operation_namespace")


def namespace_bytes(slow: DataFrame) -> DataFrame:
    return by_namespace(slow, None).select("namespace", "response_bytes")


def line_counts(entries: DataFrame) -> DataFrame:
    states = ("SUCCESS", "PARTIAL", "SKIPPED", "FAILED")
    return entries.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in states])


def parse_errors(entries: DataFrame) -> DataFrame:
    code = F.col("error_code")
    return entries.where(code.isNotNull() & (F.trim(code) != "")).groupBy("error_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_code")


def present(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("status").isin("SUCCESS", "PARTIAL"))


def time_range(entries: DataFrame) -> DataFrame:
    return present(entries).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def totals(entries: DataFrame) -> DataFrame:
    slow = F.col("is_slow") & F.col("duration_ms").isNotNull()
    return present(entries).agg(
        F.count_if(slow).alias("slow_queries"),
        F.coalesce(F.sum(F.when(slow, F.col("duration_ms"))), F.lit(0)).cast("bigint").alias("total_ms"),
        F.count_if("heartbeat_failure").alias("heartbeat_failures"),
        F.coalesce(F.bool_or(slow & F.col("cpu_nanos").isNotNull()), F.lit(False)).alias("cpu_available"),
    )


def duration_histogram(slow: DataFrame) -> DataFrame:
    """All eight buckets, with zeros where no query falls."""
    d = F.col("duration_ms")
    bucket = None
    for i, (_, _, low, _) in reversed(list(enumerate(BUCKETS))):
        bucket = F.when(d >= low, i) if bucket is None else bucket.when(d >= low, i)
    counted = slow.groupBy(bucket.alias("position")).agg(F.count("*").alias("n"), F.sum("duration_ms").cast("bigint").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    frame = slow.sparkSession.createDataFrame([(i, k, lab) for i, (k, lab, _, _) in enumerate(BUCKETS)], "position int, bucket string, label string")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total_ms", F.lit(0))
    everything = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())  # eight rows
    out = frame.join(counted, "position", "left").select(
        "position",
        "bucket",
        "label",
        n.alias("n"),
        F.when(everything > 0, n * 100.0 / everything).otherwise(0.0).alias("percent"),
        total.alias("total_ms"),
        F.coalesce(average(total, n), F.lit(0.0)).alias("avg_ms"),
        F.coalesce("max_ms", F.lit(0)).alias("max_ms"),
    )
    return out.orderBy("position")


def arrival(*sign: str) -> Column:
    return F.struct("file_index", "line_number")


def slowest(slow: DataFrame, limit: int = TOP_QUERIES) -> DataFrame:
    """The exact ranking of slow queries; each task keeps `limit` rows at most."""
    return slow.orderBy(F.desc("duration_ms"), "ts_ms", "file_index", "line_number").limit(limit)


def pattern_stats(slow: DataFrame, limit: int = TOP_PATTERNS, top: int = TOP_QUERIES) -> DataFrame:
    """Statistics of each (namespace, operation, pattern); the slowest query's id only if it is in the global ranking."""
    keys = [or_unknown(F.col(c)).alias(c) for c in ("namespace", "operation", "query_pattern")]
    plan = F.col("plan_summary")
    narrow = slow.select(*keys, "plan_summary", "duration_ms", "response_len", "cpu_nanos", "ts_ms", "file_index", "line_number", "query_id")
    stats = narrow.groupBy("namespace", "operation", "query_pattern").agg(
        *stat_columns(),
        F.array_join(F.sort_array(F.collect_set(F.when(F.trim(plan) != "", plan))), "; ").alias("plans"),
        F.bool_or(F.col("cpu_nanos").isNotNull()).alias("cpu_available"),
        F.min_by(F.struct("ts_ms", "query_id"), F.struct(-F.col("duration_ms"), "ts_ms", "file_index", "line_number")).alias("sample"),
    )
    ranked = stats.orderBy(F.desc("n"), "namespace", "operation", "query_pattern").limit(limit)
    kept = slowest(slow.select("query_id", "duration_ms", "ts_ms", "file_index", "line_number"), top).select(F.col("query_id").alias("slowest_query_id"))
    out = ranked.join(kept, F.col("sample.query_id") == F.col("slowest_query_id"), "left")
    return out.select("namespace", "operation", "query_pattern", *STAT, "plans", "cpu_available", F.col("sample.ts_ms").alias("slowest_ts_ms"), "slowest_query_id").orderBy(
        F.desc("n"), "namespace", "operation", "query_pattern"
    )


def cpu_ratio_histogram(slow: DataFrame) -> DataFrame:
    """Rows by operation and ten-percent bucket of CPU time over duration."""
    operation = F.when(F.col("operation") == "remove", "delete").otherwise(F.col("operation"))
    percent = F.col("cpu_nanos") / F.lit(1e6) / F.col("duration_ms") * 100
    bucket = (F.ceil(F.floor(percent) / 10) * 10).cast("bigint")
    rows = slow.where(F.col("cpu_nanos").isNotNull() & (F.col("duration_ms") > 0)).select(operation.alias("operation"), bucket.alias("bucket"))
    return rows.where(F.col("operation").isin(*CPU_OPERATIONS)).groupBy("operation", "bucket").agg(F.count("*").alias("n")).orderBy("operation", "bucket")


def cpu_bucket_label(bucket: Column) -> Column:
    return F.when(bucket == 0, "[0,1)%").otherwise(F.concat(F.lit("["), bucket - 9, F.lit(","), bucket + 1, F.lit(")%")))


def connections_by_hour(entries: DataFrame) -> DataFrame:
    """Hourly mean of open connections, from the attribute or the network message; hours without any are absent."""
    from_text = F.when((F.upper("component") == "NETWORK") & F.col("message").rlike(CONNECTIONS_OPEN), F.regexp_extract("message", CONNECTIONS_OPEN, 1).try_cast("bigint"))
    count = F.coalesce("connection_count", from_text)
    rows = present(entries).select(floor_to(F.col("ts_ms"), HOUR).alias("hour_ms"), count.alias("count")).where("count >= 0")
    return rows.groupBy("hour_ms").agg(F.count("*").alias("n"), average(F.sum("count"), F.count("*")).alias("avg_connections")).orderBy("hour_ms")


def connection_points(hours: DataFrame) -> DataFrame:
    """The hourly points with an empty one an hour after each that the next does not follow directly."""
    after = F.lead("hour_ms").over(Window.orderBy("hour_ms"))  # a row an hour
    marked = hours.withColumn("__next", after)
    gap = marked.where(F.col("__next") - F.col("hour_ms") > HOUR).select((F.col("hour_ms") + HOUR).alias("hour_ms"), F.lit(None).cast("double").alias("avg_connections"))
    return hours.select("hour_ms", "avg_connections").union(gap).orderBy("hour_ms")


def share(stats: DataFrame, name: str, value: str = "n") -> DataFrame:
    """Each category's part of the whole, in percent."""
    return stats.select(name, value, (F.col(value) * 100.0 / F.sum(value).over(Window.partitionBy())).alias("percent"))


def matching(rows: DataFrame, namespace: str | None = None, operation: str | None = None, plan_summary: str | None = None, min_duration_ms: int | None = None) -> DataFrame:
    out = rows.where(contains_text(F.col("namespace"), namespace) & contains_text(F.col("operation"), operation) & contains_text(F.col("plan_summary"), plan_summary))
    return out if min_duration_ms is None else out.where(F.col("duration_ms") >= min_duration_ms)


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of the rows in order, with the total on each row."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page from 1, size 1 to 200")
    total = rows.agg(F.count("*").alias("total"))
    # whole tables never come here, but the ranked rows; offset beyond an int is beyond any of them
    part = rows.orderBy(*order).offset(min((number - 1) * size, (1 << 31) - 1)).limit(size)
    return part.crossJoin(F.broadcast(total))  # one row


RANKING = (F.desc, "duration_ms"), (F.asc, "ts_ms"), (F.asc, "file_index"), (F.asc, "line_number")


def ranking() -> list[Column]:
    return [f(c) for f, c in RANKING]


def pattern_rows(patterns: DataFrame, keyword: str | None = None, operation: str | None = None, plan: str | None = None) -> DataFrame:
    """The pattern table by keyword (in namespace or pattern), exact operation and part of the plans."""
    out = patterns.where((contains_text(F.col("namespace"), keyword) | contains_text(F.col("query_pattern"), keyword)) & contains_text(F.col("plans"), plan))
    return out if not operation else out.where(F.col("operation") == operation)


def resorted(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by any column, nulls last either way."""
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


def scatter(slow: DataFrame, limit: int = TOP_QUERIES) -> DataFrame:
    """Points of the ranked queries by namespace, namespaces by their first place in the ranking."""
    top = slowest(slow.select("namespace", "ts_ms", "duration_ms", "query_id", "file_index", "line_number"), limit)
    rank = F.row_number().over(Window.orderBy(*ranking()))  # the ranked rows alone
    first = F.min("place").over(Window.partitionBy("namespace"))
    placed = top.withColumn("namespace", or_unknown(F.col("namespace"))).withColumn("place", rank)
    return placed.withColumn("series_place", first).select("series_place", "namespace", "place", "ts_ms", "duration_ms", "query_id").orderBy("series_place", "place")


def operations(slow: DataFrame) -> DataFrame:
    return slow.select("operation").distinct().orderBy("operation")
