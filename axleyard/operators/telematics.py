"""Daily telematics: sums per asset and day, plausibility, odometers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from .scan import running_sum

DAY = ["asset_id", "record_date"]


def daily_idle(events: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Idle hours per asset and day (and ``more`` columns) from events (asset_id, record_date, duration, unit): minutes only, days above zero."""
    unit = F.lower(X.js_trim(F.coalesce("unit", F.lit(""))))
    ok = events.filter(F.col("record_date").isNotNull() & F.col("duration").isNotNull() & unit.isin("", "min"))
    return ok.groupBy(*more, *DAY).agg(F.sum("duration").alias("idle_minutes")).filter("idle_minutes > 0").select(*more, *DAY, (F.col("idle_minutes") / 60).alias("idle_hours"))


def idle_plausibility(daily: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Impossible days lose their hours; high ones are flagged."""
    h = F.col("idle_hours")
    flag = F.when(h > S.MAX_IDLE_HOURS, "impossible").when(h > S.HIGH_IDLE_HOURS, "high")
    return daily.select(*more, *DAY, F.when(h <= S.MAX_IDLE_HOURS, h).alias("idle_hours"), flag.alias("idle_flag"))


def daily_mileage(rows: DataFrame, file: tuple[str, ...] = ("import_id", "user_id")) -> DataFrame:
    """Greatest distance per asset and day (exports overlap) and where it first appears; only days above zero.

    ``rows``: (import_id, user_id, asset_id, record_date, distance, pos).
    """
    ok = rows.filter(F.col("record_date").isNotNull() & F.col("distance").isNotNull())
    return ok.groupBy(*file, *DAY).agg(F.max("distance").alias("distance"), F.min("pos").alias("first_pos")).filter("distance > 0")


def latest_odometer(telematics: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """(asset_id, odometer_km) of the latest day that has one."""
    ok = telematics.filter(F.col("odometer_km").isNotNull() & ((F.col("odometer_km") != 0) if zero_is_missing else F.lit(True)))
    return ok.groupBy("asset_id").agg(F.max_by("odometer_km", "record_date").alias("odometer_km"))


def latest_engine_hours(telematics: DataFrame) -> DataFrame:
    return telematics.filter(F.col("total_engine_hours").isNotNull()).groupBy("asset_id").agg(F.max_by("total_engine_hours", "record_date").alias("total_engine_hours"))


def running_odometer(mileage: DataFrame, telematics: DataFrame, assets: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Cumulative odometer per asset in the order in which days appear in the files, from its latest reading.

    ``mileage``: daily_mileage with received_at; imports of an asset apply in the order they came. A latest
    reading of 0 is missing; then the asset's own odometer, then 0, is the base. With ``range_rows`` an asset's rows are
    spread over tasks of about as many (for assets that many exports repeat); without it they are one window.
    """
    base = F.coalesce(F.nullif("_latest", F.lit(0.0)), F.col("current_odometer"), F.lit(0.0))
    j = mileage.join(latest_odometer(telematics, True).select("asset_id", F.col("odometer_km").alias("_latest")), "asset_id", "left")
    j = j.join(assets.select("asset_id", "current_odometer"), "asset_id", "left")
    if range_rows:
        j = running_sum(running_sum(j.withColumn("_one", F.lit(1)), "asset_id", ["received_at", "import_id", "first_pos"], "distance", "_km", range_rows), "asset_id", ["received_at", "import_id", "first_pos"], "_one", "_n", range_rows)
        return j.select("import_id", "user_id", *DAY, (base + F.col("_km")).alias("odometer_km"), F.lit(None).cast("double").alias("litres_consumed"), F.col("_n").cast("int").alias("pos"))
    w = Window.partitionBy("asset_id").orderBy("received_at", "import_id", "first_pos").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("asset_id").orderBy("received_at", "import_id", "first_pos")
    return j.select("import_id", "user_id", *DAY, (base + F.sum("distance").over(w)).alias("odometer_km"), F.lit(None).cast("double").alias("litres_consumed"), F.row_number().over(order).alias("pos"))


def clean_exec_summary(rows: DataFrame) -> DataFrame:
    """Executive-summary rows with an asset -> daily hours. ``rows``: import_id, user_id, asset_id, vehicle_name, total_minutes, idle_minutes, distance, record_date, pos."""
    name = X.js_trim(F.coalesce("vehicle_name", F.lit("")))
    reason = F.when((name == "") | F.col("total_minutes").isNull() | (F.col("total_minutes") == 0), "bad_row").when(F.col("asset_id").isNull(), "no_asset")
    idle = F.coalesce("idle_minutes", F.lit(0.0))
    return rows.select(
        "import_id", "user_id", *DAY, "pos", "distance", reason.alias("reject_reason"), ((F.col("total_minutes") - idle) / 60).alias("operating_hours"), (idle / 60).alias("idle_hours"), (F.col("total_minutes") / 60).alias("total_engine_hours")
    )


def exec_odometer(cleaned: DataFrame, telematics: DataFrame, assets: DataFrame) -> DataFrame:
    """``odometer_km`` of executive-summary rows: the latest reading (0 counts), else the asset's own, plus the day's distance."""
    j = cleaned.join(latest_odometer(telematics).select("asset_id", F.col("odometer_km").alias("_latest")), "asset_id", "left").join(assets.select("asset_id", "current_odometer"), "asset_id", "left")
    odo = F.when(F.col("distance") > 0, F.coalesce("_latest", "current_odometer") + F.col("distance"))
    return j.withColumn("odometer_km", odo).drop("_latest", "current_odometer")


def daily_operating_hours(telematics: DataFrame) -> DataFrame:
    return telematics.groupBy(*DAY).agg(F.sum(F.coalesce("operating_hours", F.lit(0.0))).alias("operating_hours"))


def daily_fuel_telematics(fuel_records: DataFrame, telematics: DataFrame) -> DataFrame:
    """Litres, operating and idle hours per asset and day, over the days of either table."""
    z = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).alias(c)
    fuel = fuel_records.groupBy(*DAY).agg(z("litres"))
    tel = telematics.groupBy(*DAY).agg(z("operating_hours"), z("idle_hours"))
    j = fuel.join(tel, DAY, "full_outer")
    return j.select(*DAY, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("litres", "operating_hours", "idle_hours")))


def recorded_window(telematics: DataFrame) -> DataFrame:
    return telematics.groupBy("asset_id").agg(F.min("record_date").alias("first_date"), F.max("record_date").alias("last_date"), F.countDistinct("record_date").alias("n_days"))


def date_window(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows of an inclusive range of days: pruned partitions or a pushed filter."""
    return rows.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def fleet_composition(assets: DataFrame) -> DataFrame:
    """Whether each account has trucks and machinery; assets without a type say nothing."""
    truck = X.js_trim(F.col("asset_type")).isin(S.ON_ROAD_TYPES)
    return assets.groupBy("user_id").agg(F.coalesce(F.bool_or(truck), F.lit(False)).alias("has_trucks"), F.coalesce(F.bool_or(~truck), F.lit(False)).alias("has_machinery"))


def billing_quantities(assets: DataFrame) -> DataFrame:
    """Trucks, machines, invoice eligibility and monthly fee per account; ignored assets do not count."""
    truck = F.coalesce(X.js_trim(F.col("asset_type")).isin(S.ON_ROAD_TYPES), F.lit(False))
    g = assets.filter(~F.coalesce("is_ignored", F.lit(False))).groupBy("user_id").agg(F.count_if(truck).alias("trucks"), F.count_if(~truck).alias("machines"))
    return g.select("*", (F.col("trucks") + F.col("machines") >= S.INVOICE_MIN_ASSETS).alias("invoice_eligible"), (S.PLATFORM_FEE + S.TRUCK_FEE * F.col("trucks") + S.MACHINE_FEE * F.col("machines")).alias("monthly_fee"))


def avg_cost_per_litre(assets: DataFrame, purchases: DataFrame) -> DataFrame:
    p = purchases.groupBy(F.col("vehicle_id").alias("asset_id")).agg((F.sum("cost_nzd") / F.nullif(F.sum("litres"), F.lit(0.0))).alias("avg_cost_per_litre"), F.lit(True).alias("_has"))
    return assets.select("asset_id").join(p, "asset_id", "left").select("asset_id", "avg_cost_per_litre", F.coalesce("_has", F.lit(False)).alias("fuel_pricing_available"))
