"""The package on the executors, for stages that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: what the driver can import says nothing about them."""
    if spark.conf.get("tracewright.shipped", None) == spark.sparkContext.applicationId:
        return
    path = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / "tracewright").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    spark.conf.set("tracewright.shipped", spark.sparkContext.applicationId)
