"""Sessions, and what executors need to run this library."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make the package importable in all Python workers, on whatever machine; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lexquarry-"), "lexquarry.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)  # Spark's own file server hands it to the executors
    sc._lexquarry_shipped = True


def local_session(cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lexquarry")
    for k, v in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.streaming.stopTimeout": "60s",
    }.items():
        builder = builder.config(k, conf.pop(k, v))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
