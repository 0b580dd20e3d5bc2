"""Send this repository's code to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PACKAGES = ("ledgerlake", "fixtures", "catalog")

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send the packages to the Python workers, once per Spark application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-code-"), "ledgerlake_code.zip")
    with zipfile.ZipFile(archive, "w") as code:
        for package in PACKAGES:
            for folder, _, files in os.walk(os.path.join(ROOT, package)):
                for file in files:
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        code.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
