"""Python code for the executors: the package travels with the application where they don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once, unless workers find it by PYTHONPATH or their working folder."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in paths or Path.cwd() == _ROOT or getattr(context, "_docweave_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="docweave-"), "docweave.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((_ROOT / "docweave").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(at)
    context._docweave_shipped = True
