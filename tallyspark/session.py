"""A Spark session with the settings that the engine's semantics rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive plans; the warehouse is a temporary folder unless given."""
    settings = {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-"),
    } | conf
    builder = SparkSession.builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
