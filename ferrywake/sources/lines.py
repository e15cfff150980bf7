"""Lines of plain and gzip text files, numbered from 1 in each file, in the order the files are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Archive formats that are refused.
REFUSED = (".zip", ".bz2", ".xz", ".7z")


#: Splits up to which their offsets are broadcast: three numbers each.
SPLITS = 1_000_000


def refused(path: Column) -> Column:
    """Whether a file of this name is of a format that is not read."""
    return F.lower(path).rlike("(" + "|".join(x.replace(".", r"\.") for x in REFUSED) + ")$")


def check(paths: list[str]) -> None:
    if not paths:
        raise ValueError("no file given")
    for p in paths:
        if p.lower().endswith(REFUSED):
            raise ValueError(f"compression of this kind is not read: {p}")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_index, line_number, raw_line). Plain files are read in splits; gzip by its suffix, a task a file.

    A line's number is the count of lines in the splits of its file before its own, plus its place in its split. The
    place is the distance of two row ids of one task, so the text is neither exchanged nor sorted; a first pass counts
    the lines of each split, and what comes of it is one row a split."""
    check(paths)
    rows = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).select(F.lit(i).alias("file_index"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw_line"))
        rows = one if rows is None else rows.union(one)
    rows = rows.withColumn("mid", F.monotonically_increasing_id())
    counts = rows.groupBy("file_index", "file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("file_index").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file_index", "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    if rows.rdd.getNumPartitions() <= SPLITS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["file_index", "file", "block"]).select("file_index", (F.col("mid") + F.col("shift") + 1).cast("bigint").alias("line_number"), "raw_line")
