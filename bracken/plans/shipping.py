"""Sends the package to the Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(os.path.abspath(__file__)).parent.parent
#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application; Spark serves the archive to every executor, also to those that come later."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
