"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def _remove(name: str) -> None:
    with contextlib.suppress(OSError):
        os.unlink(name)


def ship_package(spark: SparkSession) -> None:
    """Add the package to the workers' path, once per application: they need not share the driver's file system."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="codeloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    # Executors that join later fetch it, too, so it stays until the driver ends.
    atexit.register(_remove, name)
    _SHIPPED.add(sc.applicationId)
