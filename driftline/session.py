"""Session settings every operator relies on, and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on. On a cluster the master and sizes come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, since functions are pickled by reference to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="driftline-zip-"), "driftline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``. Where none is set, a local master gets a temporary one; on a
    cluster that is an error, since executors would each write to a disk of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="driftline-ckpt-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_scratch: dict[str, list[str]] = {}


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this application, once the results that read them are written; returns how many.

    They are not deleted by themselves, since a DataFrame built on one may be read at any later time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    Needed where a value must not change when a lost task is run again (partition numbers, row ids) and between
    rounds of an iterative job. Unlike a checkpointed plan, a written table brings its true size, so the joins that
    follow are planned on facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that a step made and that nothing will read again, not even what it returns."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _scratch[spark.sparkContext.applicationId].remove(path)


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only where the counted rows fit; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
