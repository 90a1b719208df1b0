"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kvlake.sources import fs

_own: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in local tests."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="kvlake-")
        fs.delete_on_exit(spark, _own[app])
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/kvlake-{name}-{uuid.uuid4().hex}"
    fs.delete_on_exit(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table on shared storage: its lineage ends there, so a lost executor costs no recomputation.

    The write's own shuffle files are deleted as it ends; nothing else reads them."""
    spark = df.sparkSession
    path = new_path(spark, name)
    old = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing will read them again."""
    for t in tables:
        fs.delete(t.sparkSession, t._scratch_path)
