"""The package on the executors: Python functions of a plan are sent by name, so every worker must import them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(str(path))
    _DONE[sc.applicationId] = str(path)
