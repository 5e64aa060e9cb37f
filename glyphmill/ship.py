"""Makes the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's files, once per application; workers import it from there."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _shipped:
            _add(spark)
            _shipped.add(app)


def _add(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="glyphmill-"), "glyphmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("glyphmill", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
