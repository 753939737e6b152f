"""Make the package importable by Python workers that don't share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Send the package to the executors once a Spark application, unless their path has it."""
    home = Path(__file__).resolve().parent
    path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    application = spark.sparkContext.applicationId
    if str(home.parent) in path or application in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="quillrow-")) / "quillrow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
