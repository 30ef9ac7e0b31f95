"""Gives the Python workers of all executors this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1500


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the context's Python files, and bound the rows of Arrow batches, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_verdance_shipped", False):
        return
    top = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="verdance-ship-")) / "verdance-package.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(where))
    # Texts are long: batches of the default 10,000 rows would take much of a worker's memory. A smaller setting stays.
    if int(spark.conf.get(BATCH_ROWS, "10000")) > ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))
    sc._verdance_shipped = True
