"""Gives the Python workers of a session this library, as spark-submit --py-files would."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT = set()


def ship(spark: SparkSession) -> None:
    """Once per application. The archive is staged beside the driver, which serves it to the executors."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    staged = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens-library.zip")
    with zipfile.ZipFile(staged, "w") as archive:
        if not os.path.exists(os.path.join(package, "__init__.py")):
            archive.writestr("ledgerlens/__init__.py", "")  # archives have no namespace packages
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.join("ledgerlens", os.path.relpath(path, package)))
    context.addPyFile(staged)
    _SENT.add(context.applicationId)
