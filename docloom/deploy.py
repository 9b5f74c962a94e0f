"""Ship the package and files to Python workers that cannot read them from their own path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def temporary_folder(prefix: str) -> str:
    """A folder of the driver alone, from which Spark serves files to the workers; it goes when the driver's Python ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    context = spark.sparkContext
    key = (context.applicationId, "")
    if key in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(temporary_folder("docloom-code-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(key)


def ship_file(spark: SparkSession, path: str) -> str:
    """Have Spark serve a file of the driver to all workers, once per application: the name for ``SparkFiles.get`` there."""
    context = spark.sparkContext
    key = (context.applicationId, path)
    if key not in _shipped:
        context.addFile(path)
        _shipped.add(key)
    return os.path.basename(path)
