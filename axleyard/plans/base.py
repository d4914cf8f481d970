"""How queries are registered beside the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fleet, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: HotSpot runs methods of over 8,000 bytes of code uncompiled: plans of many columns are better run operator by operator.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200"}


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded to ``places`` and whole numbers as long: what is compared."""
    round_ = lambda c, t: F.round(c, places).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c)
    return df.select(*(round_(c, t) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "", places: int = 6):
    """Registers a function of a Fleet. ``doubles``: the columns that the SQL side rounds to ``places``."""

    def register(f: Callable[[Fleet], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
            return plain(f(Fleet(spark, sf_dir)), places)

        QUERIES[name] = run
        if sql:
            full = with_views(sql)
            if doubles:
                full = f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) AS {c}' for c in doubles.split())}) FROM ({full})"
            ORACLES[name] = full
        return f

    return register
