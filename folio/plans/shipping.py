"""Makes this package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package with the application once, unless PYTHONPATH already leads workers to it."""
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if os.path.realpath(ROOT) in on_path or app in _shipped:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "folio_package"), "zip", ROOT, "folio")
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
