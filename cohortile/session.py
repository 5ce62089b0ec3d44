"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortile", master: str | None = None, conf: dict | None = None):
    """A session with adaptive execution on; skewed join partitions are split at run time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it; only a local master falls back to /tmp."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = tempfile.mkdtemp(prefix="cohortile-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; ``release`` deletes those of a session."""
    path = f"{shared_dir(spark).rstrip('/')}/cohortile/{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_cohortile_made", []).append(path)
    return path


def fingerprint(spark: SparkSession, folder: str) -> str:
    """What lies in a folder: a digest of its path and of the names, sizes and times of its files, two levels deep."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = [folder]
    for status in files.listStatus(at):
        inner = files.listStatus(status.getPath()) if status.isDirectory() else [status]
        seen += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in inner]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def kept(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], cluster: str) -> DataFrame:
    """The table stored under ``key`` in this context, built if it is not there yet.

    It is bucketed and sorted by the column ``cluster``, so grouping and joining by that column needs no
    shuffle. ``release`` drops it.
    """
    tables = spark.sparkContext.__dict__.setdefault("_cohortile_kept", {})
    if key not in tables:
        name = f"cohortile_{uuid.uuid4().hex}"
        writer = build().write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), cluster).sortBy(cluster)
        writer.option("path", run_dir(spark, "kept")).format("parquet").saveAsTable(name)
        tables[key] = name
    return spark.table(tables[key])


def release(spark: SparkSession) -> int:
    """Delete the stored tables of this session's context; results that have not been read yet lose them."""
    made = spark.sparkContext.__dict__.pop("_cohortile_made", [])
    for name in spark.sparkContext.__dict__.pop("_cohortile_kept", {}).values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    gateway = spark.sparkContext._jvm
    for path in made:
        at = gateway.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def stored(df, name: str = "table"):
    """Write ``df`` once under the shared folder and read it back: the lineage ends there, and ``release`` deletes it."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per context, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_cohortile_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cohortile-"), "cohortile.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._cohortile_shipped = True
