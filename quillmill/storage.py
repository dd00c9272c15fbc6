"""Tables written to storage that driver and executors share, for results that several steps read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "quillmill.own.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a new local folder for this session.

    Off local mode executors would each write to a disk of their own there, so it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set(_OWN, where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended: its folder is then the cluster's to clear
        pass


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillmill-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Lineage ends there, so a lost executor costs a reread and not a recomputation, and
    Catalyst knows the written size when it chooses between broadcast and shuffle.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what materialize() wrote for df, once nothing reads it any more; other frames are left alone."""
    if path := getattr(df, "_quillmill_path", None):
        _remove(df.sparkSession, path)
