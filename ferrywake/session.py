"""A session with the settings the plans count on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """Returns the running session with our settings, or starts one, and sends this package to its executors. Names in
    settings use _ for . as in spark_sql_x."""
    builder = SparkSession.builder.appName("ferrywake")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, unless their search path has it by PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="ferrywake-")  # Spark serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "ferrywake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(ROOT, "ferrywake")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. On one machine a temporary folder
    does where none is named; on a cluster one must be."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="ferrywake-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        where = f"file://{_own[app]}"
    return where.rstrip("/")
