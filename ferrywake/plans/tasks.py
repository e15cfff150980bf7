"""Analyses as rows: their listing and their progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listing(tasks: DataFrame) -> DataFrame:
    """tasks (task_id, created_ms, ..), the latest first; of one time by id."""
    return tasks.orderBy(F.desc("created_ms"), "task_id")


def progress(done_bytes: Column, total_bytes: Column, completed: Column) -> Column:
    """Percent of the bytes read: 100 only for a completed task, at most 99.9 for any other, 0 where nothing is to be read."""
    share = F.when(total_bytes > 0, F.least(F.lit(99.9), done_bytes.cast("double") * 100 / total_bytes.cast("double"))).otherwise(F.lit(0.0))
    return F.when(completed, F.lit(100.0)).otherwise(share)
