"""Intermediate tables in the folder that all executors share.

Iterations write what the next round reads, so that plans stay short and a lost executor costs
a stage. The folder is the session's ``spark.checkpoint.dir``; only a session on one machine
without it gets a temporary one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Removes a query's shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LEFT: dict[str, list[str]] = {}


def _clean(spark: SparkSession, app: str) -> None:
    for where in _LEFT.pop(app, []):
        try:
            remove(spark, where)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexiloom-stage-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir("file://" + own)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def remove(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``df`` as a table, reread; :func:`done` removes it early, the driver's end at the latest.

    The shuffles it took are removed with the write's end. ``options`` are the Parquet writer's.
    """
    spark = df.sparkSession
    where = f"{folder(spark)}/lexiloom-core/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _LEFT:
        _LEFT[app] = []
        atexit.register(_clean, spark, app)
    _LEFT[app].append(where)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**{"compression": "zstd"} | options).parquet(where)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(where)
    out.where_ = where
    return out


def done(*tables: DataFrame) -> None:
    """Removes tables of :func:`written` that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table.where_)
