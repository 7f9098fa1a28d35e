"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped_to: set[str] = set()

# Correctness settings (UTC, Arrow) and the adaptive features the plans lean on:
# skew-join splitting, partition coalescing and run-time bloom filters.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("faultline")
    settings = {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        # Keep all cores busy on tables of a few megabytes.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions started without --py-files."""
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    folder = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="faultline-package-")) / f"{folder.name}.zip"
    # The driver serves the archive to the executors itself; they need no shared path.
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(folder.rglob("*.py")):
            archive.write(source, source.relative_to(folder.parent))
    context.addPyFile(str(target))
    _shipped_to.add(context.applicationId)
