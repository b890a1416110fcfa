"""The package on executors that have no copy of it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def package_zip(folder: str) -> str:
    """The package's modules as ``orderlake.zip`` in a folder, for ``spark-submit --py-files`` or ``ship``."""
    path = os.path.join(folder, "orderlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in sorted(os.walk(_PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(_PACKAGE)))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a session, once; workers that find it elsewhere use that."""
    if not any(path.endswith("/orderlake.zip") for path in spark.sparkContext.listFiles):
        # The driver hands the file to executors as they come, so it stays while the driver runs.
        folder = tempfile.mkdtemp(prefix="orderlake-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(package_zip(folder))
