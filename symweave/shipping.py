"""The package on the executors, wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_symweave_shipped", False):
        return
    # the driver serves the file as long as it runs
    folder = tempfile.mkdtemp(prefix="symweave-sources-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "symweave_sources.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))
    context._symweave_shipped = True
