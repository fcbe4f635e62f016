"""Session construction, the package on the executors, and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def get_spark(app: str = "cellshift", master: str | None = None, shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings the operators assume. Cluster sizing stays with spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared:
        builder = builder.config(_CHECKPOINT_KEY, shared)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package (and the modules beside it that it runs from), once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cellshift-package-")  # the driver serves the archive from here; no data goes in
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "cellshift_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in [*package.rglob("*.py"), *package.parent.glob("corpus_pipeline.py")]:
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: what the cluster names in spark.checkpoint.dir.

    Where that is unset, intermediate tables go below the warehouse, which executors share as well. On a
    cluster a folder of the driver's own disk is refused.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    return f"{warehouse}/intermediate"


def run_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/cellshift/{app}"
    if _folders.get(app) != path:
        _folders[app] = path
        atexit.register(clear_tables, spark)
    return path


def clear_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Call it before stop(); at exit it runs by itself."""
    context = spark.sparkContext
    if context._jsc is None or context.applicationId not in _folders:
        return
    delete(spark, _folders.pop(context.applicationId))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store the path names."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts lineage durably (the files outlive any executor), gives the planner true sizes for its
    broadcast decisions, and keeps column pruning for later readers.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` has stored, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            delete(table.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def data_version(spark: SparkSession, path: str) -> str:
    """Bytes, number of files and time of the last change of a location in any store; empty if it is none."""
    system, where = _file_system(spark, path)
    if not system.exists(where):
        return ""
    summary = system.getContentSummary(where)
    changed = max([system.getFileStatus(where).getModificationTime(), *(s.getModificationTime() for s in system.listStatus(where))])
    return f"{summary.getLength()}-{summary.getFileCount()}-{changed}"


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if there is no such folder."""
    system, where = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def rename(spark: SparkSession, path: str, target: str) -> bool:
    """Give a file its name; False, and nothing done, if the name is taken."""
    system, where = _file_system(spark, path)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return not system.exists(named) and bool(system.rename(where, named))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file in whatever store the path names."""
    system, where = _file_system(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
