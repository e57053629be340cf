"""A local session for tests and benches; on a cluster, use the session that the cluster gives."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from driftline.runtime import ship


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    os.environ.setdefault("TZ", "UTC")
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # tasks, not threads within them, share the cores
    builder = SparkSession.builder.master(f"local[{cores}]").appName("driftline")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
