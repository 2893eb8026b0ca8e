"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers import the functions that a plan refers to; on a cluster
    the package is not on their path unless it was submitted with the job.
    """
    context = spark.sparkContext
    if getattr(context, "_presencia_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="presencia-"), "presencia_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("presencia", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._presencia_shipped = True
