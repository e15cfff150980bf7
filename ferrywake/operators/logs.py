"""Log lines to entries: routing, both formats, parse outcomes.

raw lines (file_index, line_number, raw_line) become one row each with the status and error code of the
line and, where it could be read at all, the entry's columns. Structured lines are parsed once into a
variant from which all fields come; only single-line slow operations visit Python, for their shell-style
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of, query_shape, trimmed, without_bom
from ..functions.values import at, exact_long, kind_of
from .legacy import documents

# Commands that name an operation, and single-line operations that count as slow queries.
COMMANDS = ("find", "aggregate", "insert", "update", "delete", "getMore", "findAndModify", "createIndexes", "addShard", "replSetInitiate", "createUser", "moveChunk")
SLOW_OPERATIONS = ("find", "aggregate", "insert", "update", "remove", "getMore", "findAndModify", "createIndexes")
# Patterns of the single-line format.
HEADER = r"^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+(.*)$"
DATE_START = r"^\d{4}-\d{2}-\d{2}T"
COMMAND_OPERATION = r"command:\s*(findAndModify|createIndexes|aggregate|insert|getMore|find)\s*\{"
DURATION = r"(?:^|\s)([^\s]+)ms\s*$"
PLAN = r"planSummary:\s*(\S+)"
RESPONSE_LENGTH = r"reslen:\s*(\S+)"
NETWORK_REMOTE = r"(?:connection accepted from|end connection)\s+([^ :]+)(?::\d+)?"
STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:[.,]\d{1,9})?)?(?:Z|[+-]\d\d(?::?\d\d)?)$"

ENTRY = (
    "ts_ms severity component message_id context message namespace operation duration_ms cpu_nanos response_len plan_summary remote query_pattern is_slow heartbeat_failure envelope attr".split()
)


def _found(x: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def _millis(text: Column) -> Column:
    return F.when(text.rlike(STAMP), F.unix_millis(F.try_to_timestamp(text)))


def _overlong(line: Column) -> Column:
    """Whether a bare whole number anywhere outside of strings exceeds a long."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"(?<![\d.eE+-])(-?\d{19,})(?![\d.eE])"), F.lit(1))
    return F.when(line.rlike(r"\d{19}"), F.exists(numbers, lambda n: n.try_cast("bigint").isNull())).otherwise(F.lit(False))


def structured(lines: DataFrame) -> DataFrame:
    """Entries of lines whose __line starts with a brace."""
    df = lines.withColumn("__v", F.when(~_overlong(F.col("__line")), F.try_parse_json("__line")))
    v = F.col("__v")
    bad = v.isNull() | ~F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))
    t, date = at(v, "$.t"), at(v, '$.t["$date"]')
    as_number = F.coalesce(exact_long(date), at(date, '$["$numberLong"]', "string").try_cast("bigint"), F.when(~kind_of(t).startswith("OBJECT"), exact_long(t)))
    ts = F.coalesce(_millis(F.when(kind_of(date) == "STRING", date.cast("string"))), _millis(F.when(kind_of(t) == "STRING", t.cast("string"))), as_number)
    attr = F.when(kind_of(at(v, "$.attr")).startswith("OBJECT"), at(v, "$.attr"))
    df = df.withColumns({"__bad": bad, "ts_ms": ts, "attr": attr, "message": at(v, "$.msg", "string")})
    attr = F.col("attr")
    command = at(attr, "$.command")
    # the first key of the command in the order of the line, which a variant does not keep
    first_key = F.get(F.json_object_keys(F.get_json_object("__line", "$.attr.command")), F.lit(0))
    kind = at(attr, "$.type", "string")
    operation = F.when(first_key.isin(*COMMANDS), first_key).when(kind.isNull() | (F.trim(kind) == ""), "command").otherwise(kind)
    df = df.withColumn("operation", operation)

    def doc(path: str) -> Column:
        return F.to_json(at(attr, path))

    updates = at(attr, "$.command.updates", "array<variant>")
    q = F.transform(updates, lambda u: F.coalesce(F.to_json(F.try_variant_get(u, "$.q", "variant")), F.lit("null")))
    source = (
        F.when(~F.coalesce(kind_of(command).startswith("OBJECT"), F.lit(False)), F.lit(None))
        .when(F.col("operation") == "find", doc("$.command.filter"))
        .when(F.col("operation") == "aggregate", doc("$.command.pipeline"))
        .when(F.col("operation") == "update", F.when(updates.isNotNull(), F.concat(F.lit("["), F.array_join(q, ","), F.lit("]"))).otherwise(doc("$.command.q")))
        .when(F.col("operation") == "delete", doc("$.command.deletes"))
        .when(F.col("operation") == "findAndModify", doc("$.command.query"))
        .when(F.col("operation") == "getMore", F.coalesce(doc("$.originatingCommand.pipeline"), doc("$.originatingCommand.filter")))
        .when(F.col("operation") == "createIndexes", doc("$.command.indexes"))
        .otherwise(doc("$.command.q"))
    )
    msg = F.col("message")
    df = df.withColumns(
        {
            "severity": at(v, "$.s", "string"),
            "component": at(v, "$.c", "string"),
            "message_id": at(v, "$.id", "int"),
            "context": at(v, "$.ctx", "string"),
            "namespace": at(attr, "$.ns", "string"),
            "duration_ms": exact_long(at(attr, "$.durationMillis")),
            "cpu_nanos": exact_long(at(attr, "$.cpuNanos")),
            "response_len": exact_long(at(attr, "$.reslen")),
            "plan_summary": at(attr, "$.planSummary", "string"),
            "remote": host_of(F.coalesce(at(attr, "$.remote", "string"), at(attr, "$.client", "string"))),
            "query_pattern": query_shape(source),
            "is_slow": F.coalesce(F.lower(msg) == "slow query", F.lit(False)),
            "heartbeat_failure": F.coalesce(F.contains(msg, F.lit("Heartbeat failed")), F.lit(False)),
            "envelope": F.struct(
                at(v, "$.svc", "string").alias("service"),
                F.coalesce(at(v, "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
                F.coalesce(at(v, "$.truncated").isNotNull() & (kind_of(at(v, "$.truncated")) != "VOID"), F.lit(False)).alias("truncated"),
            ),
        }
    )

    def given(path: str) -> Column:
        x = at(attr, path)
        return x.isNotNull() & (kind_of(x) != "VOID")

    slow = F.col("is_slow")
    wrong = (given("$.cpuNanos") & F.col("cpu_nanos").isNull()) | (given("$.reslen") & F.col("response_len").isNull())
    code = (
        F.when(F.col("__bad"), "INVALID_STRUCTURED_JSON")
        .when(F.col("ts_ms").isNull(), "MISSING_TIMESTAMP")
        .when(slow & F.col("duration_ms").isNull(), F.when(F.coalesce(given("$.durationMillis"), F.lit(False)), "INVALID_SLOW_QUERY_DURATION").otherwise("MISSING_SLOW_QUERY_DURATION"))
        .when(slow & F.coalesce(wrong, F.lit(False)), "INVALID_SLOW_QUERY_METRICS")
    )
    status = F.when(F.col("__bad") | F.col("ts_ms").isNull(), "FAILED").when(code.isNotNull(), "PARTIAL").otherwise("SUCCESS")
    return df.withColumns({"error_code": code, "status": status})


def single_line(lines: DataFrame) -> DataFrame:
    """Entries of all other lines."""
    line = F.col("__line")
    df = lines.withColumn("__ok", line.rlike(HEADER))
    stamp, component, message = (F.regexp_extract(line, HEADER, i) for i in (1, 3, 5))
    df = df.withColumns(
        {
            "ts_ms": F.when(F.col("__ok") & stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}(?:Z|[+-]\d{4})$"), F.unix_millis(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXX")))),
            "severity": F.regexp_extract(line, HEADER, 2),
            "component": component,
            "context": F.regexp_extract(line, HEADER, 4),
            "message": message,
        }
    )
    msg, part = F.col("message"), F.upper("component")
    operation = (
        F.when((part == "WRITE") & msg.startswith("update "), "update")
        .when((part == "WRITE") & msg.startswith("remove "), "remove")
        .when((part == "COMMAND") & msg.rlike(COMMAND_OPERATION), F.regexp_extract(msg, COMMAND_OPERATION, 1))
        .when(part == "NETWORK", "network")
        .otherwise(F.lower("component"))
    )
    df = df.withColumn("operation", operation)
    df = df.withColumn("is_slow", F.col("ts_ms").isNotNull() & F.col("operation").isin(*SLOW_OPERATIONS))
    # only slow operations have documents to read
    df = df.withColumn("__docs", documents(F.when(F.col("is_slow"), msg), F.when(F.col("is_slow"), F.col("operation"))))
    df = df.withColumn("__command", F.try_parse_json("__docs.command")).withColumn("__origin", F.try_parse_json("__docs.origin"))
    command, origin, op = F.col("__command"), F.col("__origin"), F.col("operation")

    def doc(of: Column, path: str) -> Column:
        return F.to_json(at(of, path))

    source = (
        F.when(op == "find", doc(command, "$.filter"))
        .when(op == "aggregate", doc(command, "$.pipeline"))
        .when(op.isin("update", "remove"), doc(command, "$.q"))
        .when(op == "findAndModify", doc(command, "$.query"))
        .when(op == "getMore", F.coalesce(doc(origin, "$.pipeline"), doc(origin, "$.filter")))
        .when(op == "createIndexes", doc(command, "$.indexes"))
    )
    words = F.split(msg, r"\s+", 3)
    named = F.when(F.get(words, F.lit(0)).isin("command", "update", "remove", "insert"), F.get(words, F.lit(1)))
    created = F.concat_ws(".", at(command, '$["$db"]', "string"), at(command, "$.createIndexes", "string"))
    both = at(command, '$["$db"]', "string").isNotNull() & at(command, "$.createIndexes", "string").isNotNull()

    def number(pattern: str) -> Column:
        n = F.when(_found(msg, pattern).rlike(r"^[+-]?\d+$"), _found(msg, pattern).try_cast("bigint"))
        return F.when(n >= 0, n)

    df = df.withColumns(
        {
            "message_id": F.lit(None).cast("int"),
            "namespace": F.when((op == "createIndexes") & both, created).otherwise(named),
            "duration_ms": number(DURATION),
            "cpu_nanos": F.lit(None).cast("bigint"),
            "response_len": number(RESPONSE_LENGTH),
            "plan_summary": _found(msg, PLAN),
            "remote": _found(msg, NETWORK_REMOTE),
            "query_pattern": F.when(command.isNull(), "{}").otherwise(query_shape(source)),
            "heartbeat_failure": F.contains(msg, F.lit("Heartbeat failed")),
            "envelope": F.lit(None).cast("struct<service:string,tags:array<string>,truncated:boolean>"),
            "attr": command,
        }
    )
    slow = F.col("is_slow")
    code = (
        F.when(line == "", "EMPTY_LINE")
        .when(~F.col("__ok"), F.when(line.rlike(DATE_START), "INVALID_LEGACY_HEADER").otherwise("NOT_MONGODB_LOG"))
        .when(F.col("ts_ms").isNull(), "INVALID_TIMESTAMP")
        .when(slow & F.col("duration_ms").isNull(), F.when(msg.rlike(DURATION), "INVALID_SLOW_QUERY_DURATION").otherwise("MISSING_SLOW_QUERY_DURATION"))
        .when(slow & msg.rlike(RESPONSE_LENGTH) & F.col("response_len").isNull(), "INVALID_SLOW_QUERY_METRICS")
        .when(slow & (op != "insert") & command.isNull(), "LEGACY_COMMAND_PARTIAL")
    )
    skipped = (line == "") | (~F.col("__ok") & ~line.rlike(DATE_START))
    status = F.when(skipped, "SKIPPED").when(~F.col("__ok") | F.col("ts_ms").isNull(), "FAILED").when(code.isNotNull(), "PARTIAL").otherwise("SUCCESS")
    return df.withColumns({"error_code": code, "status": status})


def routed(raw_line: Column) -> Column:
    """The line without a leading byte-order mark and outer white space; structured lines are those that begin with a brace."""
    return trimmed(without_bom(F.coalesce(raw_line, F.lit(""))))


def is_structured(raw_line: Column) -> Column:
    return routed(raw_line).startswith("{")


def line_metadata(raw: DataFrame) -> DataFrame:
    """What only the raw line of an entry tells: its message id, context, service and tags, of either format."""
    there = entries(raw).where(F.col("status").isin("SUCCESS", "PARTIAL"))
    return there.select("file_index", "line_number", "message_id", "context", "component", F.col("envelope.service").alias("service"), F.array_join("envelope.tags", ",").alias("tags"))


def entries(raw: DataFrame) -> DataFrame:
    """raw (file_index, line_number, raw_line) as one row a line; the entry's columns are null unless status is SUCCESS or
    PARTIAL."""
    lines = raw.select("file_index", "line_number", "raw_line", routed(F.col("raw_line")).alias("__line"))
    parsed = structured(lines.where(F.col("__line").startswith("{"))).unionByName(single_line(lines.where(~F.col("__line").startswith("{"))), allowMissingColumns=True)
    there = F.col("status").isin("SUCCESS", "PARTIAL")
    return parsed.select("file_index", "line_number", "raw_line", "status", "error_code", *[F.when(there, F.col(c)).alias(c) for c in ENTRY])


def slow_queries(rows: DataFrame) -> DataFrame:
    """Entries of slow queries with a known duration, with their id."""
    kept = rows.where(F.col("status").isin("SUCCESS", "PARTIAL") & F.col("is_slow") & F.col("duration_ms").isNotNull())
    return kept.withColumn("query_id", F.concat_ws("-", "file_index", "line_number"))
