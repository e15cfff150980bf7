"""Metric series: merging of captures, deltas, statistics, gaps, bounded downsampling.

samples is the long frame (path, file_id, block_start, block_ordinal, point_idx, ts_ms, value); a series is
(path, ts_ms, value) with one row for each time. Every metric of a group goes through one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import average
from ..sources.store import kept

# Paths that are their own groups by prefix, and those of no group.
SPECIAL_PREFIXES = (
    "serverStatus/wiredTiger/cache/forced eviction - pages",
    "serverStatus/wiredTiger/capacity/background",
    "serverStatus/wiredTiger/capacity/bytes",
    "serverStatus/wiredTiger/capacity/time",
    "serverStatus/wiredTiger/cache/pages",
    "serverStatus/wiredTiger/cache/history",
    "serverStatus/wiredTiger/cache/eviction",
    "serverStatus/wiredTiger/cache/bytes",
    "serverStatus/wiredTiger/cache/application",
    "serverStatus/wiredTiger/transaction/transaction",
    "serverStatus/wiredTiger/transaction/rollback",
    "systemMetrics/netstat/TcpExt",
    "systemMetrics/netstat/Tcp",
    "systemMetrics/netstat/IpExt",
    "systemMetrics/netstat/Ip",
)
EXCLUDED = ("start", "end", "serverStatus/globalLock/totalTime", "serverStatus/wiredTiger/oplog/visibility timestamp/t", "serverStatus/wiredTiger/oplog/visibility timestamp/i")
GROUP_METRICS, GROUP_POINTS, PAGE_POINTS = 200, 1200, 1000
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Query:
    """What to show of a series: a time range (inclusive), at most so many points, raw or delta values."""

    start_ms: int | None = None
    end_ms: int | None = None
    max_points: int = 1000
    view: str = "raw"

    def __post_init__(self) -> None:
        if not 1 <= self.max_points <= 2000:
            raise ValueError("max_points is 1 to 2000")
        if self.view not in ("raw", "delta"):
            raise ValueError("view is raw or delta")
        if self.start_ms is not None and self.end_ms is not None and self.start_ms > self.end_ms:
            raise ValueError("the range ends before it starts")


def group_name(path: Column) -> Column:
    name = None
    for p in SPECIAL_PREFIXES:
        name = F.when(path.startswith(p), p) if name is None else name.when(path.startswith(p), p)
    parent = F.regexp_extract(path, "^(.+)/[^/]*$", 1)
    name = name.otherwise(F.when(parent != "", parent).otherwise(path))
    return F.regexp_replace(name, "^serverStatus/", "")


def stable_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 16)


def groups(metrics: DataFrame) -> DataFrame:
    """(group_id, name, path, metric_id) of metrics (path), but for the excluded ones."""
    kept = metrics.select("path").distinct().where(~F.col("path").isin(*EXCLUDED))
    return kept.select(stable_id(group_name(F.col("path"))).alias("group_id"), group_name(F.col("path")).alias("name"), "path", stable_id(F.col("path")).alias("metric_id"))


def merged(samples: DataFrame) -> DataFrame:
    """One value for each path and time: that of the lowest file, then the earliest block and point.

    A grouped minimum, so each task combines its rows before the exchange."""
    first = F.struct("file_id", "block_start", "block_ordinal", "point_idx")
    return samples.groupBy("path", "ts_ms").agg(F.min_by("value", first).alias("value"))


def increasing(samples: DataFrame) -> DataFrame:
    """As merged(), for files whose times step back: a point is kept only if its time exceeds all before it in its block
    order, as a sequential merge of the files would."""
    rows = samples.withColumn("__part", part_of("block_start"))
    order = Window.partitionBy("path", "file_id", "__part").orderBy("block_start", "block_ordinal", "point_idx").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("path", "file_id", "__part").agg(F.max("ts_ms").alias("__top"))
    earlier = Window.partitionBy("path", "file_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("path", "file_id", "__part", F.max("__top").over(earlier).alias("__before"))
    seen = rows.withColumn("__inside", F.max("ts_ms").over(order)).join(tops, ["path", "file_id", "__part"])
    seen = seen.withColumn("__seen", F.greatest("__inside", "__before"))
    return merged(seen.where("__seen IS NULL OR ts_ms > __seen").select(*samples.columns))


#: A path is cut into ranges of this length, so that a busy one is not one task.
RANGE_MS = 24 * 3_600_000


def part_of(time: str) -> Column:
    return F.floor(F.col(time) / RANGE_MS)


def with_previous(series: DataFrame) -> DataFrame:
    """series with the time and value of the point before (prev_ms, prev_value) and the place of each in its path from 1.

    Within ranges of time by a window; across them by the last point of each range, of which there are few."""
    rows = series.select("path", "ts_ms", "value", part_of("ts_ms").alias("__part"))
    inside = Window.partitionBy("path", "__part").orderBy("ts_ms")
    ends = rows.groupBy("path", "__part").agg(F.max(F.struct("ts_ms", "value")).alias("__last"), F.count("*").alias("__n"))
    before = Window.partitionBy("path").orderBy("__part")
    ends = ends.select("path", "__part", F.lag("__last").over(before).alias("__before"), F.coalesce(F.sum("__n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))
    near = rows.withColumn("__near", F.lag(F.struct("ts_ms", "value")).over(inside)).withColumn("__i", F.row_number().over(inside))
    prev = F.coalesce("__near", "__before")
    return near.join(ends, ["path", "__part"]).select("path", "ts_ms", "value", prev["ts_ms"].alias("prev_ms"), prev["value"].alias("prev_value"), (F.col("__n") + F.col("__i")).cast("bigint").alias("place"))


def in_range(rows: DataFrame, query: Query) -> DataFrame:
    if query.start_ms is not None:
        rows = rows.where(F.col("ts_ms") >= query.start_ms)
    return rows if query.end_ms is None else rows.where(F.col("ts_ms") <= query.end_ms)


def by_time() -> Window:
    return Window.partitionBy("path").orderBy("ts_ms")


def wrapped(a: Column, b: Column) -> Column:
    """a - b as 64-bit arithmetic that wraps."""
    exact = a.cast("decimal(20,0)") - b.cast("decimal(20,0)")
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    over, under = exact > F.lit(LARGEST), exact < F.lit(-LARGEST - 1)
    return F.when(over, exact - span).when(under, exact + span).otherwise(exact).cast("bigint")


def delta(series: DataFrame) -> DataFrame:
    """The change from the previous point of the range; null at the first."""
    return with_previous(series).select("path", "ts_ms", wrapped(F.col("value"), F.col("prev_value")).alias("value"))


def view(series: DataFrame, query: Query) -> DataFrame:
    ranged = in_range(series, query)
    return delta(ranged) if query.view == "delta" else ranged.select("path", "ts_ms", "value")


def stats(series: DataFrame) -> DataFrame:
    """Exact statistics over all points of a view; null values count for nothing."""
    v = F.col("value")
    return series.groupBy("path").agg(
        F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), average(F.sum(v.cast("decimal(38,0)")), F.count(v)).alias("avg_value"),
        F.coalesce((F.min(v) == 0) & (F.max(v) == 0), F.lit(False)).alias("all_zero"),
    )


def ends(series: DataFrame) -> DataFrame:
    return series.groupBy("path").agg(
        F.count("*").alias("points"), F.min("ts_ms").alias("first_ms"), F.min_by("value", "ts_ms").alias("first_value"), F.max("ts_ms").alias("last_ms"), F.max_by("value", "ts_ms").alias("last_value")
    )


def intervals(series: DataFrame) -> DataFrame:
    """(path, from_ms, to_ms, gap_ms, ordinal) between neighbouring points, numbered from 1 in each path."""
    steps = with_previous(series)
    return steps.select("path", F.col("prev_ms").alias("from_ms"), F.col("ts_ms").alias("to_ms"), (F.col("ts_ms") - F.col("prev_ms")).alias("gap_ms"), (F.col("place") - 1).alias("ordinal")).where("gap_ms > 0")


def typical(steps: DataFrame) -> DataFrame:
    """The usual interval of each path: the lower median of those up to ten times the lower median.

    Over counts of each interval, of which there are few however long the series."""
    counts = steps.groupBy("path", "gap_ms").agg(F.count("*").alias("n"))

    def median(rows: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("path")
        upto = F.sum("n").over(w.orderBy("gap_ms"))
        marked = rows.withColumns({"__upto": upto, "__all": F.sum("n").over(w)})
        return marked.where("__upto * 2 >= __all").groupBy("path").agg(F.min("gap_ms").alias(name))

    rough = median(counts, "rough")
    near = counts.join(rough, "path").where("gap_ms <= rough * 10").select("path", "gap_ms", "n")
    return median(near, "typical_ms")


def gaps(series: DataFrame, max_points: int) -> DataFrame:
    """(path, from_ms, to_ms, gap_ms, typical_ms): intervals over three times the usual, the largest `max_points` of each
    path."""
    steps = kept(intervals(series).drop("ordinal"))
    wide = steps.join(typical(steps), "path").where("gap_ms > typical_ms * 3")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("gap_ms"), "from_ms"))
    return wide.withColumn("__i", rank).where(F.col("__i") <= max(1, max_points)).drop("__i")


def reservoir_slots(steps: DataFrame, capacity: int = 4096) -> DataFrame:
    """(path, slot, gap_ms): the intervals a fixed-size deterministic reservoir would hold. A slot is a function of an
    interval's ordinal, so the last ordinal of each slot stays."""
    wide = "decimal(38,0)"
    half, whole = F.lit(str(1 << 32)).cast(wide), F.lit(str(1 << 64)).cast(wide)

    def bound(x: Column, use) -> Column:
        """use(x), with x computed once."""
        return F.get(F.transform(F.array(x), use), F.lit(0))

    def unsigned(x: Column) -> Column:
        return F.when(x < 0, x.cast(wide) + whole).otherwise(x.cast(wide))

    def signed(x: Column) -> Column:
        return F.when(x > F.lit(LARGEST), x - whole).otherwise(x).cast("bigint")

    def times(x: Column, k: int) -> Column:
        """x * k modulo 2^64, by halves of x so that no product leaves 38 digits."""
        low, high = (F.lit(str(v)).cast(wide) for v in (k % (1 << 64), k % (1 << 32)))
        parts = x.bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(10,0)") * low.cast("decimal(20,0)") + (F.shiftrightunsigned(x, 32).cast("decimal(10,0)") * high.cast("decimal(10,0)") % half).cast("decimal(10,0)") * half.cast("decimal(10,0)")
        return bound(parts.cast(wide) % whole, signed)

    # The shifts and factors of the 64-bit mixer.
    def mixed(x: Column) -> Column:
        x = times(x.bitwiseXOR(F.shiftrightunsigned(x, 30)), 0xBF58476D1CE4E5B9)
        x = bound(x, lambda v: times(v.bitwiseXOR(F.shiftrightunsigned(v, 27)), 0x94D049BB133111EB))
        return bound(x, lambda v: unsigned(v.bitwiseXOR(F.shiftrightunsigned(v, 31))))

    at = F.col("ordinal")
    slot = F.when(at <= capacity, at - 1).otherwise((mixed(at) % at).cast("bigint"))
    return steps.withColumn("slot", slot).where(F.col("slot") < capacity).groupBy("path", "slot").agg(F.max_by("gap_ms", "ordinal").alias("gap_ms"))


def downsampled(series: DataFrame, query: Query) -> DataFrame:
    """At most max_points of each path: all points if they and the gap markers fit, else the ends, the extrema of equal
    time buckets, and markers (null values) of the widest gaps.

    The range of the buckets is the query's, or that of all the paths' points where it is open."""
    n = query.max_points
    series = kept(series)  # five parts of the plan read it
    bounds = series.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))  # one row
    lo = F.lit(query.start_ms) if query.start_ms is not None else F.col("lo")
    hi = F.lit(query.end_ms) if query.end_ms is not None else F.col("hi")
    raw_buckets = max(0, (n - 2) // 2)
    bounds = bounds.select(lo.cast("bigint").alias("range_start"), F.greatest(F.lit(1), F.ceil((hi - lo + 1) / max(1, raw_buckets))).cast("bigint").alias("width"))
    e = ends(series)
    g = gaps(series, n).join(e.select("path", "first_ms", "last_ms"), "path").where("from_ms >= first_ms AND to_ms <= last_ms")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("gap_ms"), "from_ms"))
    edge = F.when(F.col("first_ms") == F.col("last_ms"), 1).otherwise(min(2, n))
    g = g.withColumn("__i", rank).where(F.col("__i") <= n - edge)
    markers = g.select("path", (F.col("from_ms") + F.least(F.col("gap_ms") - 1, F.greatest(F.lit(1), F.col("typical_ms")))).alias("ts_ms"), F.lit(None).cast("bigint").alias("value"))
    plan = e.join(g.groupBy("path").agg(F.count("*").alias("n_gaps")), "path", "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
    plan = plan.withColumn("whole", F.col("points") + F.col("n_gaps") <= n).withColumn("targets", F.greatest(F.lit(0), F.floor((n - edge - F.col("n_gaps")) / 2)))
    # what of a path is shown is decided by one row a path, which goes to its points by a join
    with_plan = series.join(plan.select("path", "whole", "targets"), "path")
    everything = with_plan.where("whole").select("path", "ts_ms", "value")
    cut = with_plan.where("NOT whole AND value IS NOT NULL AND targets > 0").crossJoin(F.broadcast(bounds))
    bucket = F.least(F.lit(max(0, raw_buckets - 1)), F.greatest(F.lit(0), F.floor((F.col("ts_ms") - F.col("range_start")) / F.col("width"))))
    target = F.least(F.col("targets") - 1, F.floor(bucket * F.col("targets") / max(1, raw_buckets)))
    extremes = cut.where(F.lit(raw_buckets > 0)).groupBy("path", target.alias("target")).agg(
        F.min_by(F.struct("ts_ms", "value"), F.struct("value", "ts_ms")).alias("low"), F.max_by(F.struct("ts_ms", "value"), F.struct(F.col("value"), -F.col("ts_ms"))).alias("high")
    )
    extremes = extremes.select("path", F.explode(F.array("low", "high")).alias("p")).select("path", "p.ts_ms", "p.value")
    bounds_ = plan.where("NOT whole").select("path", F.explode(F.array(F.struct(F.col("first_ms").alias("ts_ms"), F.col("first_value").alias("value")), F.struct(F.col("last_ms").alias("ts_ms"), F.col("last_value").alias("value")))).alias("p"))
    bounds_ = bounds_.select("path", "p.ts_ms", "p.value")
    points = everything.union(extremes).union(bounds_).union(markers).groupBy("path", "ts_ms").agg(F.max("value").alias("value"))
    place = F.row_number().over(by_time())
    return points.withColumn("__i", place).where(F.col("__i") <= n).drop("__i")


def page(series: DataFrame, offset: int, limit: int) -> DataFrame:
    """Points of one path by time, from an offset, with the total on each row."""
    if offset < 0 or not 1 <= limit <= PAGE_POINTS:
        raise ValueError(f"offset from 0, limit 1 to {PAGE_POINTS}")
    total = series.agg(F.count("*").alias("total"))
    return series.orderBy("path", "ts_ms").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def overlapping(blocks: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return blocks.where((F.col("end_ms") >= start_ms) & (F.col("start_ms") <= end_ms))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """blocks with the number of points before each, in block order."""
    before = Window.partitionBy("file_id").orderBy("block_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("point_offset", F.coalesce(F.sum(F.col("num_deltas") + 1).over(before), F.lit(0)))


def catalog_totals(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks"), F.sum(F.col("num_deltas") + 1).cast("bigint").alias("samples"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def schemas_of(blocks: DataFrame) -> DataFrame:
    """(paths, schema_id): distinct lists of paths, numbered by first appearance."""
    first = blocks.groupBy("paths").agg(F.min(F.struct("file_id", "block_ordinal")).alias("seen"))
    return first.select("paths", (F.row_number().over(Window.orderBy("seen")) - 1).alias("schema_id"))  # a row a schema


def paths_in_order(schemas: DataFrame) -> DataFrame:
    """(place, path): every path once, in the order of its first appearance in the schemas."""
    each = schemas.select("schema_id", F.posexplode("paths").alias("pos", "path"))
    first = each.groupBy("path").agg(F.min(F.struct("schema_id", "pos")).alias("seen"))
    return first.select((F.row_number().over(Window.orderBy("seen")) - 1).cast("bigint").alias("place"), "path")  # a row a path


def blocks_of_metrics(blocks: DataFrame, metrics: DataFrame) -> DataFrame:
    """(file_id, block_ordinal, path, position): where each metric (path) stands in the blocks (file_id, block_ordinal, paths)
    that have it; a metric that no block has gives no row."""
    each = blocks.select("file_id", "block_ordinal", F.posexplode("paths").alias("position", "path"))
    return each.join(metrics.select("path").distinct(), "path").select("file_id", "block_ordinal", "path", "position")


def kept_paths(metrics: DataFrame) -> DataFrame:
    """The distinct paths of metrics but for the excluded ones."""
    excluded = metrics.sparkSession.createDataFrame([(p,) for p in EXCLUDED], "path string")
    return metrics.select("path").subtract(excluded)


def path_schemas(schemas: DataFrame) -> DataFrame:
    """(path, metric_id, schema_ids, place): each path with the schemas it is in, by first appearance."""
    each = schemas.select("schema_id", F.posexplode("paths").alias("pos", "path"))
    out = each.groupBy("path").agg(F.sort_array(F.collect_set("schema_id")).alias("schema_ids"), F.min(F.struct("schema_id", "pos")).alias("seen"))
    return out.select("path", stable_id(F.col("path")).alias("metric_id"), "schema_ids", "seen")


def only_nonzero(series: DataFrame) -> DataFrame:
    """Without the series that are zero throughout."""
    return series.join(stats(series).where("all_zero").select("path"), "path", "left_anti")


def chosen_groups(groups_: DataFrame, names: list[str] | None = None, prefixes: list[str] | None = None, keyword: str | None = None) -> DataFrame:
    hit = F.lit(False) if names or prefixes else F.lit(True)
    if names:
        hit |= F.col("name").isin(*names)
    for p in prefixes or []:
        hit |= F.col("name").startswith(p)
    return groups_.where(hit & (F.contains(F.lower("name"), F.lit(keyword.strip().lower())) if keyword and keyword.strip() else F.lit(True)))
