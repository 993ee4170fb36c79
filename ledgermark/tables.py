"""Tables that several plans share, written to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where such tables go if a session of one machine (local master, as in tests) names no shared folder.
LOCAL_WORK = "/tmp/ledgermark-work"
#: Folders of this process's sessions that ``clear`` removes.
_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session of one machine may go without: on a cluster a folder of one
    machine is lost with it, so its absence is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = LOCAL_WORK
    return path.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the shared one."""
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back. What builds on it has a short plan, computes
    nothing twice, and loses nothing with an executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove the tables that this process has written so far; for when no frame that reads them is needed any more."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        path = jvm(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
