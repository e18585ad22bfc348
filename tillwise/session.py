"""Session defaults for tests, the bench and stand-alone jobs.

On a cluster the session comes from the platform. Results do not depend on the settings
below; they decide how the work is cut into tasks. No reader changes a session's settings.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the package is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillwise")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TILLWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Cut the tasks of a hot join key also where its lines stay grouped by that key: one more
        # shuffle, of partial sums only, spares a single task for a product with a third of all lines.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .getOrCreate()
    )
