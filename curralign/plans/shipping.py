"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, unless their search path already has it."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    on_path = str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    name = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
