"""Utilisation of assets by calendar day over the days they were recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from .telematics import daily_operating_hours, recorded_window


def utilisation_status(rate: Column, target: Column, has_row: Column, available: Column, actual: Column) -> Column:
    return (
        F.when(~has_row, "no-data").when((available <= 0) & (actual > 0), "exceeds-capacity").when(target.isNull(), "no-target")
        .when(rate > 100, "exceeds-capacity").when(rate >= target, "on-target").otherwise("below-target")
    )


def _period(assets: DataFrame, telematics: DataFrame) -> DataFrame:
    hours = F.coalesce(X.safe_num(F.col("available_hours_per_week")), F.lit(S.DEFAULT_HOURS_PER_WEEK))
    a = assets.select("asset_id", hours.alias("hours_per_week"), X.safe_num(F.col("target_utilisation_percent")).alias("target"))
    w = recorded_window(telematics).join(a, "asset_id")
    days = X.calendar_days(F.col("first_date"), F.col("last_date"))
    return w.withColumn("period_available", F.col("hours_per_week") * days / 7).withColumn("working_days", X.working_days(F.col("first_date"), F.col("last_date")))


def utilisation_daily(assets: DataFrame, telematics: DataFrame) -> DataFrame:
    """Each calendar day of an asset's recorded window: available and actual hours, rate, status. Weekends have no capacity."""
    days = _period(assets, telematics).withColumn("record_date", F.explode(F.sequence("first_date", "last_date")))
    j = days.join(daily_operating_hours(telematics).withColumnRenamed("operating_hours", "actual"), ["asset_id", "record_date"], "left")
    available = F.when(F.weekday("record_date") < 5, F.col("period_available") / F.col("working_days")).otherwise(0.0)
    j = j.withColumn("available_hours", available).withColumn("has_row", F.col("actual").isNotNull()).withColumn("actual_hours", F.coalesce("actual", F.lit(0.0)))
    j = j.withColumn("rate", F.when(F.col("available_hours") > 0, F.col("actual_hours") / F.nullif("available_hours", F.lit(0.0)) * 100))
    return j.select("asset_id", "record_date", "available_hours", "actual_hours", "rate", "target", utilisation_status(F.col("rate"), F.col("target"), F.col("has_row"), F.col("available_hours"), F.col("actual_hours")).alias("status"))


def utilisation_kpis(assets: DataFrame, telematics: DataFrame) -> DataFrame:
    actual = telematics.groupBy("asset_id").agg(F.sum(F.coalesce("operating_hours", F.lit(0.0))).alias("actual_hours"))
    j = _period(assets, telematics).join(actual, "asset_id")
    rate = F.when(F.col("period_available") > 0, F.col("actual_hours") / F.nullif("period_available", F.lit(0.0)) * 100)
    return j.select("asset_id", F.col("period_available").alias("available_hours"), "actual_hours", rate.alias("rate"), "target", (rate - F.col("target")).alias("variance"))


def sparse_window_note(windows: DataFrame, start: str, end: str) -> DataFrame:
    """``sparse``: the chosen range is far wider than the recorded one."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    chosen, data = X.calendar_days(s, e), X.calendar_days(F.col("first_date"), F.col("last_date"))
    inside = (s >= F.col("first_date")) & (e <= F.col("last_date"))
    return windows.withColumn("sparse", ~inside & ((chosen > data * 1.25) | (chosen - data >= 14)))
