"""Making the package known to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once an application, unless their path has it already."""
    app = spark.sparkContext.applicationId
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SHIPPED or str(ROOT) in known:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quire-package-"), "quire.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "quire").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
