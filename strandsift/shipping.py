"""Makes this package importable on executors, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_strandsift_shipped", False):
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="strandsift-src-")) / "strandsift.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(path))
        sc._strandsift_shipped = True
    return spark
