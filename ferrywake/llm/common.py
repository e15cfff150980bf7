"""Shared plumbing: table access, stored intermediates, streaming over sorted groups."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stashes(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ferrywake/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes what stash() has written in this application; results that still read it are void."""
    _delete(spark, _stashes(spark))
    _stored.clear()


_stored: list[str] = []


def stored() -> int:
    """How many tables stash() has written so far."""
    return len(_stored)


def forget(spark: SparkSession, since: int) -> None:
    """Deletes the tables written since then, but for the last, which must be all that is still read."""
    for path in _stored[since:-1]:
        _delete(spark, path)
    del _stored[since:-1]


def stash(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_stashes(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def only(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """The columns an operator reads and no others, so that further columns of any name do no harm."""
    return docs.select(F.col(key).cast("long").alias(key), *columns)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to be none of the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches, rows: int = 1024, size: int = 8 << 20):
    """The batches in parts of at most `rows` rows and about `size` bytes, so that memory does not follow the batches."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the length of the arrays at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
