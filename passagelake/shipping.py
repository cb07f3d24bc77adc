"""Sends the library to the executors, where it isn't installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a Spark application: add the package to the Python path of all workers, through Spark's own files."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not when imported from an archive, which was sent already
        folder = tempfile.mkdtemp(prefix="passagelake-ship-")  # on the driver only
        made = shutil.make_archive(os.path.join(folder, package.name), "zip", package.parent, package.name)
        context.addPyFile(made)
    _sent.add(context.applicationId)
