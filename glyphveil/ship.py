"""Sends this package to the executors where they can't import it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application; nothing if the workers' PYTHONPATH names the folder of the package already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="glyphveil-code-")) / "glyphveil.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "glyphveil").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
