"""Tables that cut lineage, written to the folder that all executors share.

The folder comes from ``spark.checkpoint.dir``. Only where that is unset, in sessions on one
machine (unit tests), a temporary folder is set as the session's checkpoint folder; a cluster
without the setting is an error. Written tables survive lost executors: a later stage rereads
them instead of recomputing.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
        if where is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
            sc.setCheckpointDir(where)
            where = sc.getCheckpointDir()
    return where.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new, unused folder in the shared place; removed when the driver ends."""
    out = f"{root(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = []
        atexit.register(_clean, spark, app)
    _ROOTS[app].append(out)
    return out


def drop(spark: SparkSession, where: str) -> None:
    """Deletes one scratch folder; only for tables that nothing will read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean(spark: SparkSession, app: str) -> None:
    for where in _ROOTS.pop(app, []):
        try:
            drop(spark, where)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns the table as reread."""
    spark = df.sparkSession
    where = path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.scratch_path = where
    return out


def release(kept: DataFrame) -> None:
    """Deletes a table of :func:`keep` that nothing will read again."""
    drop(kept.sparkSession, kept.scratch_path)


def sampled(rows: DataFrame, label: str, seed: str, per_label: int, most_bytes: int) -> list[Row]:
    """A sample of bounded rows and bytes of (doc_id, text, label): of each label about
    ``per_label`` different rows with the least hashes, and of all these, in the order of the
    hash, the first with ``most_bytes`` of text."""
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # a row for each class of a model
    hashed = rows.withColumn("at_", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", label), F.lit(1 << 40)))
    below = F.lit(0)
    for value, n in sizes.items():
        below = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(int(min(1.0, per_label / n) * (1 << 40)))).otherwise(below)
    few = hashed.where(F.col("at_") < below).dropDuplicates(["at_", label])
    before = Window.orderBy("at_", label).rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("bytes_", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    return few.where(F.col("bytes_") < most_bytes).orderBy("doc_id", "text", label).select("doc_id", "text", label).collect()


def tidy(spark: SparkSession) -> None:
    """Lets the driver forget finished plans, whose shuffle files executors then delete.

    A plan's last references go between the first collection and the second.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application.

    Executors then need neither an installed package nor a shared PYTHONPATH.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexiloom-source-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, folder, True)
    where = f"{folder}/lexiloom_llm.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for source in (package.parent / "__init__.py", *package.glob("*.py")):
            z.write(source, f"lexiloom/{source.relative_to(package.parent)}")
    spark.sparkContext.addPyFile(where)
    _SHIPPED.add(app)


#: Rows of text an Arrow batch holds, unless the session says otherwise: it bounds what a worker holds at once.
BATCH_ROWS = 2000


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped first, in batches of bounded rows."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(run, schema)


def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums counter arrays (block, int64 bytes) by block number inside one task."""
    total: dict[int, np.ndarray] = {}
    for batch in source:
        for k, b in zip(batch.column("block").to_pylist(), batch.column("counters")):
            part = np.frombuffer(b.as_buffer(), dtype=np.int64)
            total[k] = total[k] + part if k in total else part.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "counters"])
