"""Session settings and the shared workspace.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``: driver and executors all see it, so a lost
executor costs only the tasks that ran on it. Nothing is written to a
machine-local folder unless the session itself is local and names none.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_SHIPPED: set[str] = set()


def build_session(name: str = "siltstone", cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: executors fetch it as a zip file from the shared folder, which is written once a session.

    In a local session workers see the folder itself. Without a shared
    folder they need it on their own path.
    """
    context = spark.sparkContext
    if context.master.startswith("local"):
        path = context.environment.get("PYTHONPATH", "")
        if ROOT not in path.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
        return
    if context.applicationId in _SHIPPED or not spark.conf.get("spark.checkpoint.dir", None):
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(ROOT, "siltstone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{workspace(spark)}/siltstone-code/{context.applicationId}/siltstone.zip")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(archive.getvalue())
    out.close()
    context.addPyFile(system.makeQualified(path).toString())
    _SHIPPED.add(context.applicationId)


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from the session; a temporary folder stands in only for a local
    session that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def table_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/siltstone/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the workspace and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._siltstone_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames from ``written`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_siltstone_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_workspace(spark: SparkSession) -> None:
    """Delete every intermediate table, once no frame that reads one is in use."""
    _delete(spark, f"{workspace(spark)}/siltstone")
