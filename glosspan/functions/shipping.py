"""Sends this package to the executors once per application, wherever the driver imported it from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    folder = tempfile.mkdtemp(prefix="glosspan-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "glosspan_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(_PACKAGE):
            dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
