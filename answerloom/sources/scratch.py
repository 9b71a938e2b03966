"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The paths written inside each open ``scope``, innermost last.
_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only a session on the local machine may go without: then a temporary folder is made, once for each session. On a
    cluster that would be another folder on each machine, so there it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing has yet; removed when the innermost ``scope`` ends."""
    path = f"{shared_dir(spark)}/answerloom-{kind}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and gives the optimizer true sizes, by which it decides on
    broadcasts.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope() -> Iterator[None]:
    """Removes at its end what was written into the shared folder inside it.

    Write what must outlast it outside of it, or with a path of your own: DataFrames are lazy, so one that was made
    inside can't be read any more.
    """
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            remove(spark, path)
