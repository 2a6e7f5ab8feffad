"""Puts this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to every executor, once for each application.

    Executors fetch the archive from the driver, so nothing has to be installed there.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp()) / "tessitura.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
