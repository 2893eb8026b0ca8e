"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where it is unset and all runs on one machine (tests, a laptop) a
    folder of its own below the local temporary folder is taken, and remembered
    for the session. On a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(spark, "_presencia_shared_root", None)
        if root is None:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), f"presencia-{uuid.uuid4().hex}")
            spark._presencia_shared_root = root
    return root.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/presencia/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_home(spark)}/{getattr(spark, '_presencia_scratch', '')}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables that are written inside; its name
    is given, and ``clear_scratch`` deletes it when nothing reads them any more."""
    before, name = getattr(spark, "_presencia_scratch", ""), f"scratch-{uuid.uuid4().hex}/"
    spark._presencia_scratch = name
    try:
        yield name
    finally:
        spark._presencia_scratch = before


def clear_scratch(spark: SparkSession, name: str) -> None:
    _delete(spark, f"{_home(spark)}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear_written(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder. For
    the end of a job: tables made of it can't be read any more."""
    _delete(spark, _home(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive an executor; what follows reads
    only the columns it needs. ``clear_written`` removes them all.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
