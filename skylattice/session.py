"""Session settings that item tables rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",  # properties may differ only by case
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session_defaults(spark: SparkSession) -> SparkSession:
    """Sets the settings above on a session and returns it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_skylattice_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="skylattice-")
    root = Path(__file__).resolve().parent.parent
    context.addPyFile(shutil.make_archive(f"{folder}/skylattice", "zip", root, "skylattice"))
    context._skylattice_shipped = True
