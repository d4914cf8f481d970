"""Daily emissions with the split into operating and idle fuel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from .telematics import daily_fuel_telematics


def emissions_daily(assets: DataFrame, fuel_records: DataFrame, telematics: DataFrame) -> DataFrame:
    """Per asset and day: litres split by idle rate, kg CO2 of each part, and the running total."""
    a = assets.select("asset_id", "asset_name", X.default_idle_rate(F.col("idle_burn_rate_lph"), F.col("asset_type")).alias("_rate"), X.emission_factor(F.col("fuel_type")).alias("_factor"))
    d = daily_fuel_telematics(fuel_records, telematics).join(a, "asset_id")
    idle = F.least(F.col("idle_hours") * F.col("_rate"), F.col("litres"))
    d = d.withColumn("idle_litres", idle).withColumn("operating_litres", F.col("litres") - idle)
    for part in ("operating", "idle"):
        d = d.withColumn(f"{part}_kg", F.col(f"{part}_litres") * F.col("_factor"))
    d = d.withColumn("kg", F.col("litres") * F.col("_factor"))
    w = Window.partitionBy("asset_id").orderBy("record_date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cumulative_kg", F.sum("kg").over(w)).drop("_rate", "_factor")


def emissions_kpis(daily: DataFrame) -> DataFrame:
    g = daily.groupBy("asset_id").agg(*(F.sum(c).alias(c) for c in ("litres", "operating_kg", "idle_kg", "kg", "operating_hours")))
    return g.select("asset_id", "litres", "operating_kg", "idle_kg", (F.col("kg") / 1000).alias("tonnes"), F.when(F.col("operating_hours") > 0, F.col("kg") / F.nullif("operating_hours", F.lit(0.0))).otherwise(0.0).alias("kg_per_operating_hour"))
