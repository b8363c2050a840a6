"""Session-level helpers: lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session may fall back to a temp folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="reprise-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STAGES: dict[tuple[str, str], str] = {}
_SHIPPED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a stage of this application when it ends; a session that is gone already leaves it to the cluster."""
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder, deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, with ``schema`` where a column has another
    reading of the same stored form (a struct read as a vector)."""
    path = shared_path(df.sparkSession, "tables")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def stage_table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet stage cut in the shared folder, built on first use in this application.

    Later stages read it back with column pruning and filter pushdown instead of recomputing it.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _STAGES:
        path = shared_path(spark, "stages")
        build().write.parquet(path, compression="zstd")
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def folder_version(spark: SparkSession, folder: str) -> str:
    """A mark that changes when a table of the folder is rewritten: names, sizes and times of its entries."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return str(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def row_tasks(table: DataFrame, task_rows: int) -> int:
    """Number of tasks, two at least, that have about ``task_rows`` rows of a Parquet table each; its footers tell how many."""
    return max(2, -(-table.count() // task_rows))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="reprise-package-")), "reprise_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "reprise")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
