"""The two workspaces: analysis of logs, and a store of metric captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import logs
from ..operators import series as S
from ..operators import summary as A
from ..sources import capture, lines
from ..sources.store import publish
from . import report


class LogAnalysis:
    """Entries of some log files and the fixed questions about them.

    All questions read one table of entries: kept in memory, or at a path if one is given."""

    def __init__(self, entries: DataFrame, files: list[str] | None = None):
        self.entries = D.diagnostic_columns(entries)
        self.files = files or []
        self.slow = logs.slow_queries(self.entries)

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: list[str], store: str | None = None) -> LogAnalysis:
        entries = logs.entries(lines.read_lines(spark, paths))
        if not store:
            return cls(entries.persist(), paths)
        publish(entries, store)
        return cls.open(spark, store, paths)

    @classmethod
    def open(cls, spark: SparkSession, store: str, files: list[str] | None = None) -> LogAnalysis:
        """The analysis of entries that from_paths stored."""
        return cls(spark.read.parquet(store), files)

    def summary(self) -> dict[str, DataFrame]:
        e, s = self.entries, self.slow
        return {
            "line_counts": A.line_counts(e), "parse_errors": A.parse_errors(e), "time_range": A.time_range(e), "totals": A.totals(e), "duration_histogram": A.duration_histogram(s),
            "by_operation": A.by_operation(s), "by_namespace": A.by_namespace(s), "by_pattern": A.by_pattern(s), "by_plan": A.by_plan(s), "by_remote": A.by_remote(s),
            "cpu_by_operation_namespace": A.cpu_by_operation_namespace(s), "pattern_stats": A.pattern_stats(s), "namespace_bytes": A.namespace_bytes(s),
            "cpu_ratio_histogram": A.cpu_ratio_histogram(s), "connections_by_hour": A.connections_by_hour(e), "slowest": A.slowest(s),
        }

    def diagnostics(self) -> dict[str, DataFrame]:
        e = self.entries
        names = "severities quality out_of_order frequent_names shapes abnormal connections replication timeline signal_counts signal_table coverage insights overview"
        return {n: getattr(D, n)(e) for n in names.split()}

    def slow_queries(self, page: int = 1, size: int = 50, namespace: str | None = None, operation: str | None = None, min_duration_ms: int | None = None, plan_summary: str | None = None) -> DataFrame:
        return A.page(A.matching(A.slowest(self.slow), namespace, operation, plan_summary, min_duration_ms), page, size, *A.ranking())

    def slow_query_points(self) -> DataFrame:
        return A.scatter(self.slow)

    def slow_query(self, query_id: str) -> DataFrame:
        """The entry, with its figures explained. Raises KeyError if there is none."""
        found = self.slow.where(F.col("query_id") == query_id)
        if found.isEmpty():
            raise KeyError(query_id)
        return found.join(D.explanations(self.entries.where(F.concat_ws("-", "file_index", "line_number") == query_id)), "query_id")

    def report(self, title: str = "Log analysis", with_diagnostics: bool = True) -> str:
        return report.render(title, self.files, self.summary(), self.diagnostics() if with_diagnostics else None)

    def write(self, folder: str) -> None:
        """Summary and diagnostics as JSON, the ranked queries as JSON lines; each result is there whole or not at all."""
        for kind, frames in (("summary", self.summary()), ("diagnostics", self.diagnostics())):
            for name, df in frames.items():
                publish(df, f"{folder}/{kind}/{name}", "json", ignoreNullFields="false")


def written(spark: SparkSession, folder: str, name: str, like: DataFrame) -> DataFrame:
    """A result that write() left, by its kind and name (such as summary/by_plan), with the columns of the frame it is like."""
    return spark.read.schema(like.schema).json(f"{folder}/{name}").select(*like.columns)


class MetricStore:
    """Samples of captures, partitioned by metric group so that a query reads its group alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, spark: SparkSession, paths: list[str], folder: str, most_files: int | None = 20) -> MetricStore:
        if not paths or most_files and len(paths) > most_files:
            raise ValueError(f"1 to {most_files} files")
        samples = capture.read_samples(spark, paths)
        grouped = samples.withColumn("group_id", S.stable_id(S.group_name(F.col("path"))))
        publish(grouped.repartition("group_id", "path").sortWithinPartitions("path", "ts_ms"), f"{folder}/samples", partition_by="group_id")
        blocks = capture.read_blocks(spark, paths).drop("payload", "offsets", "zeros")
        publish(S.with_offsets(blocks), f"{folder}/blocks")
        publish(capture.manifest(spark, paths), f"{folder}/files")
        return cls(spark, folder)

    def samples(self, group_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/samples")
        return df if group_id is None else df.where(F.col("group_id") == group_id)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def catalog(self) -> dict[str, DataFrame]:
        schemas = S.schemas_of(self.blocks())
        return {"totals": S.catalog_totals(self.blocks()), "schemas": schemas, "metrics": S.path_schemas(schemas), "paths": S.paths_in_order(schemas)}

    def groups(self) -> DataFrame:
        metrics = self.blocks().select(F.explode("paths").alias("path")).distinct()
        return S.groups(metrics).groupBy("group_id", "name").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("name")

    def group_series(self, group_id: str, start_ms: int | None = None, end_ms: int | None = None, max_points: int = S.GROUP_POINTS, view: str = "raw") -> tuple[DataFrame, DataFrame]:
        """Points and statistics of every metric of a group; a metric without points has a row of statistics."""
        if max_points > S.GROUP_POINTS:
            raise ValueError(f"at most {S.GROUP_POINTS} points")
        found = self.groups().where(F.col("group_id") == group_id).first()
        if found is None:
            raise KeyError(group_id)
        if len(found.paths) > S.GROUP_METRICS:
            raise ValueError(f"a group of over {S.GROUP_METRICS} metrics")
        query = S.Query(start_ms, end_ms, max_points, view)
        shown = S.view(S.merged(self.samples(group_id).where(F.col("path").isin(found.paths))), query)
        wanted = self.spark.createDataFrame([(p,) for p in found.paths], "path string")
        return S.downsampled(shown, query), wanted.join(S.stats(shown), "path", "left")

    def series(self, path: str, start_ms: int | None = None, end_ms: int | None = None, max_points: int = 1000, view: str = "raw") -> DataFrame:
        query = S.Query(start_ms, end_ms, max_points, view)
        return S.downsampled(S.view(self._path(path), query), query)

    def _path(self, path: str) -> DataFrame:
        return S.merged(self.samples().where((F.col("group_id") == S.stable_id(S.group_name(F.lit(path)))) & (F.col("path") == path)))

    def page(self, path: str, offset: int = 0, limit: int = 1000) -> DataFrame:
        return S.page(self._path(path), offset, limit)

    def export_csv(self, path: str, out: str) -> None:
        """All merged points of a metric as gzip CSV, by time."""
        rows = self._path(path).select(F.col("ts_ms").alias("timestampEpochMillis"), "value")
        publish(rows.orderBy("timestampEpochMillis"), out, "csv", header="true", compression="gzip")

    def changed_sources(self, paths: list[str]) -> DataFrame:
        return capture.changed(self.spark.read.parquet(f"{self.folder}/files"), capture.manifest(self.spark, paths))
