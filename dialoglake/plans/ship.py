"""Hands the package to the executors, for clusters where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_given: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's modules as a zip that Spark spreads to its Python workers."""
    context = spark.sparkContext
    if context.applicationId in _given:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    context.addPyFile(str(target))
    _given.add(context.applicationId)
