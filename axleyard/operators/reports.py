"""Reports: composed from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from . import costs
from .emissions import emissions_daily
from .intervals import asof_odometers
from .telematics import avg_cost_per_litre, latest_engine_hours

#: All weights from here on share one whole tonne.
TOP_TONNES = 1_000.0


def _per(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0)))


def fuel_daily_split(assets: DataFrame, fuel_records: DataFrame, telematics: DataFrame) -> DataFrame:
    """Machinery per day: operating and idle litres, and litres an hour of each."""
    machines = assets.filter(~costs.on_road())
    d = emissions_daily(machines, fuel_records, telematics)
    return d.select("asset_id", "record_date", "operating_litres", "idle_litres", _per(F.col("operating_litres"), F.col("operating_hours")).alias("operating_lph"), _per(F.col("idle_litres"), F.col("idle_hours")).alias("idle_lph"))


def machine_fuel_cost(telematics: DataFrame, assets: DataFrame, settings: DataFrame) -> DataFrame:
    """Machinery litres times the account's price; null where the account has none."""
    m = assets.filter(~costs.on_road()).select("asset_id", F.col("user_id").alias("_account"))
    price = settings.select(F.col("user_id").alias("_account"), "machinery_fuel_cost_per_litre")
    j = telematics.join(m, "asset_id").join(price, "_account", "left")
    return j.select("asset_id", "record_date", "litres_consumed", (F.col("litres_consumed") * F.col("machinery_fuel_cost_per_litre")).alias("fuel_cost"))


def fill_to_fill_fuel(merged: DataFrame, purchases: DataFrame, period: str = "month") -> DataFrame:
    """Per asset and period of the fill: km and litres of included intervals, L/100 km, fuel $/km at the asset's price."""
    price = purchases.groupBy(F.col("vehicle_id").alias("asset_id")).agg((F.sum("cost_nzd") / F.nullif(F.sum("litres"), F.lit(0.0))).alias("_price"))
    g = merged.filter("included").groupBy("asset_id", F.date_trunc(period, "end_date").cast("date").alias("period_start")).agg(F.sum("distance_km").alias("km"), F.sum("litres").alias("litres"))
    j = g.join(price, "asset_id", "left")
    return j.select("asset_id", "period_start", "km", "litres", _per(F.col("litres") * 100, F.col("km")).alias("litres_per_100km"), _per(F.col("litres") * F.col("_price"), F.col("km")).alias("fuel_per_km"))


def ruc_rate(assets: DataFrame, rates: DataFrame) -> DataFrame:
    """Road charge per km by weight band; bands do not overlap. Bands and assets meet by whole tonnes, so the list may be of any length."""
    tonne = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(TOP_TONNES))).cast("int")
    bands = rates.filter("gvm_lo < gvm_hi").select("gvm_lo", "gvm_hi", "rate_per_km", F.explode(F.sequence(tonne(F.col("gvm_lo")), tonne(F.col("gvm_hi")))).alias("_tonne"))
    here = (F.col("_tonne") == tonne(assets["gvm_tonnes"])) & (assets["gvm_tonnes"] >= F.col("gvm_lo")) & (assets["gvm_tonnes"] < F.col("gvm_hi"))
    return assets.join(bands, here, "left").select(*(assets[c] for c in assets.columns), F.col("rate_per_km").alias("ruc_per_km"))


def cost_per_km_report(assets: DataFrame, fuel: DataFrame, rates: DataFrame) -> DataFrame:
    """Road assets per period: each part per km, the total with road charges (where all are known), and per tonne-km."""
    a = ruc_rate(assets.filter(costs.on_road()), rates)
    j = costs.running_cost_per_km(fuel.join(a, "asset_id"), "fuel_per_km")
    total = F.col("total") + F.coalesce("ruc_per_km", F.lit(0.0))
    return j.select("asset_id", "period_start", "km", "litres", "fuel_per_km", "depreciation", "maintenance", "servicing", "ruc_per_km", total.alias("total_per_km"), _per(total, F.col("gvm_tonnes")).alias("per_tonne_km"))


def hours_by_asset(telematics: DataFrame) -> DataFrame:
    z = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).alias(c)
    return telematics.groupBy("asset_id").agg(z("operating_hours"), z("idle_hours"))


def with_idle_inputs(assets: DataFrame, telematics: DataFrame, purchases: DataFrame) -> DataFrame:
    """Assets with hours, idle rate, price and meter: what idle_hour_costs reads."""
    j = assets.join(hours_by_asset(telematics), "asset_id").join(avg_cost_per_litre(assets, purchases), "asset_id", "left").join(latest_engine_hours(telematics), "asset_id", "left")
    return j.withColumn("idle_rate", X.default_idle_rate(F.col("idle_burn_rate_lph"), F.col("asset_type")))


def idle_cost_report(assets: DataFrame, telematics: DataFrame, purchases: DataFrame) -> DataFrame:
    """Engine, operating and idle hours, idle share, idle fuel cost and its share of the idle hours' total cost."""
    c = costs.idle_hour_costs(with_idle_inputs(assets, telematics, purchases))
    engine = F.col("operating_hours") + F.col("idle_hours")
    return c.select("asset_id", "user_id", "asset_name", engine.alias("engine_hours"), "operating_hours", "idle_hours", _per(F.col("idle_hours") * 100, engine).alias("idle_percent"), F.col("fuel").alias("idle_fuel_cost"), "total", _per(F.col("fuel") * 100, F.col("total")).alias("fuel_percent_of_total"))


def idle_offenders(report: DataFrame, k: int = 5) -> DataFrame:
    """The k assets of each account with the highest idle cost."""
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("idle_fuel_cost"), "asset_id")
    return report.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("user_id", "asset_id", "idle_fuel_cost", "rank")


def job_cost_report(jobs: DataFrame, assets: DataFrame, telematics: DataFrame, purchases: DataFrame) -> DataFrame:
    """Per job and asset, and per job (asset_id null): days, fuel without idling, idle cost, depreciation, servicing, maintenance, total, per operating hour and tonne."""
    z = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).alias(c)
    tel = telematics.groupBy("asset_id", "record_date").agg(z("operating_hours"), z("idle_hours"))
    bought = purchases.groupBy(F.col("vehicle_id").alias("asset_id"), F.col("purchase_date").alias("record_date")).agg(F.sum("cost_nzd").alias("bought"))
    days = jobs.withColumnRenamed("work_date", "record_date").join(tel, ["asset_id", "record_date"], "left").join(bought, ["asset_id", "record_date"], "left")
    per = days.groupBy("job_id", "asset_id").agg(F.countDistinct("record_date").alias("days_worked"), z("operating_hours"), z("idle_hours"), z("bought"), z("tonnes"))
    inputs = assets.join(avg_cost_per_litre(assets, purchases), "asset_id", "left").join(latest_engine_hours(telematics), "asset_id", "left").withColumn("idle_rate", X.default_idle_rate(F.col("idle_burn_rate_lph"), F.col("asset_type")))
    r = costs.with_rates(per.join(inputs, "asset_id"))
    hours = lambda c: F.when(F.col("on_road"), 0.0).otherwise(F.coalesce(F.col("operating_hours") * F.col(f"{c}.value"), F.lit(0.0)))
    idle = F.col("idle_hours") * F.col("idle_rate") * F.coalesce("avg_cost_per_litre", F.lit(0.0))
    r = r.select("job_id", "asset_id", "days_worked", "operating_hours", "tonnes", F.greatest(F.col("bought") - idle, F.lit(0.0)).alias("fuel_cost"), idle.alias("idle_cost"), hours("dep_hour").alias("depreciation"), hours("serv").alias("servicing"), hours("maint_hour").alias("maintenance"))
    parts = ["fuel_cost", "idle_cost", "depreciation", "servicing", "maintenance"]
    r = r.withColumn("total", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))
    g = r.rollup("job_id", "asset_id").agg(*(F.sum(c).alias(c) for c in ("days_worked", "operating_hours", "tonnes", *parts, "total"))).filter("job_id is not null")
    return g.withColumn("cost_per_operating_hour", _per(F.col("total"), F.col("operating_hours"))).withColumn("cost_per_tonne", _per(F.col("total"), F.col("tonnes")))


def trip_report(trips: DataFrame, assets: DataFrame, telematics: DataFrame, fuel: DataFrame) -> DataFrame:
    """Distance by odometers near both ends, fuel at the fill-to-fill rate, other costs, and kg CO2-e. ``fuel``: fill_to_fill_fuel."""
    ends = trips.select("asset_id", "trip_id", F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("start_date").alias("day")), F.struct(F.lit("e").alias("end"), F.col("end_date").alias("day")))).alias("p")).select("asset_id", "trip_id", "p.end", "p.day")
    odo = asof_odometers(ends, telematics).groupBy("trip_id").agg(F.max(F.when(F.col("end") == "s", F.col("odo_forward"))).alias("_from"), F.max(F.when(F.col("end") == "e", F.col("odo_backward"))).alias("_to"))
    rates = fuel.groupBy("asset_id").agg(F.sum("litres").alias("_l"), F.sum("km").alias("_k"), F.sum(F.col("fuel_per_km") * F.col("km")).alias("_c"))
    j = trips.join(odo, "trip_id", "left").join(rates, "asset_id", "left").join(assets, "asset_id")
    j = j.withColumn("distance_km", F.when(F.col("_to") > F.col("_from"), F.col("_to") - F.col("_from"))).withColumn("fuel_per_km", _per(F.col("_c"), F.col("_k"))).withColumn("_lpk", _per(F.col("_l"), F.col("_k")))
    j = costs.running_cost_per_km(j, "fuel_per_km")
    d = F.col("distance_km")
    return j.select(
        "trip_id", "asset_id", "distance_km", (d * F.col("fuel_per_km")).alias("fuel_cost"), (d * F.col("depreciation")).alias("depreciation_cost"), (d * F.col("maintenance")).alias("maintenance_cost"), (d * F.col("servicing")).alias("servicing_cost"),
        (d * F.col("total")).alias("total_cost"), F.when(d > 0, F.col("total")).alias("cost_per_km"), "payload_tonnes", _per(F.col("total"), F.col("payload_tonnes")).alias("cost_per_tonne_km"), (d * F.col("_lpk") * S.REPORT_EMISSION_FACTOR).alias("emissions_kg"),
    )


def emissions_report(fuel: DataFrame, assets: DataFrame) -> DataFrame:
    """Litres, km and kg CO2-e per asset and period, per km and per tonne-km."""
    kg = F.col("litres") * S.REPORT_EMISSION_FACTOR
    j = fuel.join(assets.select("asset_id", "gvm_tonnes"), "asset_id", "left")
    return j.select("asset_id", "period_start", "litres", "km", kg.alias("kg"), _per(kg, F.col("km")).alias("kg_per_km"), _per(kg, F.col("km") * F.col("gvm_tonnes")).alias("kg_per_tonne_km"))
