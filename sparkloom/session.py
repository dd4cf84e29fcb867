"""SparkSession construction with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Semantics-bearing settings only; sizing stays with the cluster's operator.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "sparkloom", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own."""
    n = cpus or os.cpu_count() or 4
    b = SparkSession.builder.appName(app).master(f"local[{n}]")
    local = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in {**SETTINGS, **local, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()
