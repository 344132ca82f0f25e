"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="lumenaudit-src-"), "lumenaudit_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "lumenaudit").rglob("*.py")):
            z.write(p, p.relative_to(root).as_posix())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
