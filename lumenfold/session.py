"""Session factory with the settings that the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lumenfold", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session: UTC, ANSI, adaptive execution, LAST_WIN maps. On a cluster, pass your own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("LUMENFOLD_DRIVER_MEMORY", "12g"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
