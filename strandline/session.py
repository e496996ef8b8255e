"""What a Spark session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the session's Python files, once, so that executors can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='strandline-')}/strandline", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)
    return spark
