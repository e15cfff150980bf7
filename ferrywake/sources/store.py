"""Results on disk: written beside their place and moved there when complete, so that readers find all or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def _fs(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None, **options: str) -> None:
    """Writes df and moves it to the path. What stood there before is set aside first and deleted last: until the move
    it can be read, and should the job end in between, a complete copy is there under another name."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).save(f"{path}.new-{name}")
    (old, fs), (new, _), (aside, _) = (_fs(spark, x) for x in (path, f"{path}.new-{name}", f"{path}.old-{name}"))
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{path} can't be published")
    if had:
        fs.delete(aside, True)


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: for what a plan reads several times and that is costly to make."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ferrywake-kept/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
