"""Session settings that the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC days, repeated map keys keep the last value (repeated header names), no methods too large for the JVM to compile, adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; ``master`` only where no cluster manager gives one."""
    b = SparkSession.builder.appName("axleyard").config(map=SETTINGS | (extra or {}))
    return (b.master(master) if master else b).getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import this package from where the driver has it (a cluster ships its own copy)."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
    return spark
