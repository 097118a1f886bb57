"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package's code (a small archive of .py files, once a context), so Python functions find it wherever they run."""
    sc = spark.sparkContext
    if not getattr(sc, "_textloom_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, Path(PACKAGE.name) / f.relative_to(PACKAGE))
        sc.addPyFile(path)
        sc._textloom_shipped = True
    return spark
