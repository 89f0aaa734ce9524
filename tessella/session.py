"""Making the package known to Python workers that do not share the driver's path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application, unless their path has it already."""
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _SHIPPED or any(os.path.realpath(p) == os.path.realpath(_ROOT) for p in known if p):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "tessella_src"), "zip", _ROOT, "tessella")
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)
