"""Making this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_lineament_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    # The file server reads the archive whenever an executor first asks, so it stays.
    archive = os.path.join(tempfile.mkdtemp(prefix="lineament-"), "lineament_workers.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(Path(root.name) / file.relative_to(root)))
    sc.addPyFile(archive)
    sc._lineament_shipped = True
