"""Cost rates of an asset. Each rate is a value, or the list of inputs it lacks, or a life that is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X


def on_road() -> Column:
    return X.is_on_road(F.col("is_on_road"), F.col("asset_type"))


def _num(name: str) -> Column:
    return X.safe_num(F.col(name))


def _missing(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c.isNull(), F.lit(label)) for c, label in pairs)))


def missing_depreciation(hours: Column, odometer: Column) -> Column:
    value = [(_num("current_value"), "Current Value"), (_num("estimated_end_of_life_value"), "Estimated End of Life Value")]
    road = _missing(*value, (_num("expected_life_km"), "Expected Total Life (km)"), (F.coalesce(odometer, _num("current_odometer")), "Current Odometer (km)"))
    return F.when(on_road(), road).otherwise(_missing(*value, (_num("expected_life_hours"), "Expected Total Life (hours)"), (hours, "Total Engine Hours")))


def missing_maintenance() -> Column:
    repair = (_num("estimated_annual_repair_cost"), "Estimated Annual Repair Cost")
    machine = _missing(repair, (_num("available_hours_per_week"), "Available Hours Per Week"), (_num("target_utilisation_percent"), "Target Utilisation Percent"))
    return F.when(on_road(), _missing(repair, (_num("estimated_annual_km"), "Estimated Annual KM"))).otherwise(machine)


def missing_servicing() -> Column:
    return F.when(on_road(), _missing((_num("service_cost_per_km"), "Service Cost Per KM"))).otherwise(_missing((_num("service_cost_per_hour"), "Service Cost Per Hour")))


def rate(value: Column, missing: Column, exceeded: Column | None = None, near: Column | None = None) -> Column:
    """The struct of a rate: ok, value, missing, life_exceeded, life_near_limit."""
    complete = F.size(missing) == 0
    over = F.lit(False) if exceeded is None else F.coalesce(complete & (exceeded | near), F.lit(False))
    close = F.lit(False) if near is None else F.coalesce(complete & near & ~exceeded, F.lit(False))
    ok = complete & ~over
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), missing.alias("missing"), over.alias("life_exceeded"), close.alias("life_near_limit"))


def _depreciation(life: Column, used: Column, floor: float, missing: Column) -> Column:
    remaining = life - used
    per = (_num("current_value") - _num("estimated_end_of_life_value")) / F.nullif(remaining, F.lit(0.0))
    return rate(F.greatest(per, F.lit(0.0)), missing, remaining <= 0, remaining <= F.greatest(life * S.REMAINING_LIFE_SHARE, F.lit(floor)))


def depreciation_per_hour(hours: Column) -> Column:
    return _depreciation(_num("expected_life_hours"), hours, S.MIN_REMAINING_LIFE_HOURS, missing_depreciation(hours, F.lit(None).cast("double")))


def depreciation_per_km(odometer: Column) -> Column:
    odo = F.coalesce(odometer, _num("current_odometer"))
    return _depreciation(_num("expected_life_km"), odo, S.MIN_REMAINING_LIFE_KM, missing_depreciation(F.lit(None).cast("double"), odo))


def maintenance_per_hour() -> Column:
    usage = _num("available_hours_per_week") * 52 * (_num("target_utilisation_percent") / 100)
    missing = missing_maintenance()
    short = F.array(F.lit("estimated annual usage (set Available Hours Per Week and Target Utilisation Percent)"))
    missing = F.when((F.size(missing) == 0) & F.coalesce(usage <= 0, F.lit(True)), short).otherwise(missing)
    return rate(_num("estimated_annual_repair_cost") / F.nullif(usage, F.lit(0.0)), missing)


def maintenance_per_km() -> Column:
    km = _num("estimated_annual_km")
    missing = missing_maintenance()
    missing = F.when((F.size(missing) == 0) & F.coalesce(km <= 0, F.lit(True)), F.array(F.lit("Estimated Annual KM"))).otherwise(missing)
    return rate(_num("estimated_annual_repair_cost") / F.nullif(km, F.lit(0.0)), missing)


def servicing_rate() -> Column:
    """Per km for road vehicles, per hour for machines."""
    return rate(F.when(on_road(), _num("service_cost_per_km")).otherwise(_num("service_cost_per_hour")), missing_servicing())


def life_usage(hours: Column, odometer: Column) -> Column:
    road = F.when(_num("expected_life_km") > 0, F.coalesce(odometer, _num("current_odometer")) / F.nullif(_num("expected_life_km"), F.lit(0.0)))
    return F.when(on_road(), road).otherwise(F.when(_num("expected_life_hours") > 0, hours / F.nullif(_num("expected_life_hours"), F.lit(0.0))))


def approaching_life(ratio: Column) -> Column:
    return F.coalesce(ratio >= S.APPROACHING_LIFE, F.lit(False))


def with_rates(assets: DataFrame, hours: str = "total_engine_hours", odometer: str | None = None) -> DataFrame:
    """``assets`` with the structs dep_hour, dep_km, maint_hour, maint_km, serv and ``on_road``."""
    odo = F.col(odometer) if odometer else F.lit(None).cast("double")
    return assets.select("*", on_road().alias("on_road"), depreciation_per_hour(F.col(hours)).alias("dep_hour"), depreciation_per_km(odo).alias("dep_km"), maintenance_per_hour().alias("maint_hour"), maintenance_per_km().alias("maint_km"), servicing_rate().alias("serv"))


def idle_hour_costs(assets: DataFrame) -> DataFrame:
    """Costs of idle hours. ``assets`` also has idle_hours, idle_rate, avg_cost_per_litre, fuel_pricing_available, total_engine_hours.

    Road vehicles idle on fuel alone: their other parts are 0 where they can be computed at all. The total
    adds what is known.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    r = with_rates(assets)
    priced = F.coalesce("fuel_pricing_available", F.lit(True))
    fuel = F.when(priced, z("idle_hours") * z("idle_rate") * z("avg_cost_per_litre"))
    part = lambda road, machine: F.when(F.col("on_road"), F.when(F.col(f"{road}.ok"), 0.0)).otherwise(z("idle_hours") * F.col(f"{machine}.value"))
    r = r.withColumn("fuel", fuel).withColumn("depreciation", part("dep_km", "dep_hour")).withColumn("servicing", part("serv", "serv")).withColumn("maintenance", part("maint_km", "maint_hour"))
    ok = F.when(F.col("on_road"), F.col("dep_km.ok") & F.col("maint_km.ok")).otherwise(F.col("dep_hour.ok") & F.col("maint_hour.ok")) & F.col("serv.ok")
    return r.withColumn("total", z("fuel") + z("depreciation") + z("servicing") + z("maintenance")).withColumn("has_missing", ~(priced & ok))


def running_cost_per_km(assets: DataFrame, fuel: str = "fuel_per_km", odometer: str | None = None) -> DataFrame:
    """Fuel, depreciation, servicing and maintenance per km; a total only where all four are known."""
    odo = F.col(odometer) if odometer else F.lit(None).cast("double")
    serv = rate(_num("service_cost_per_km"), missing_servicing())
    r = assets.select("*", depreciation_per_km(odo).alias("_d"), serv.alias("_s"), maintenance_per_km().alias("_m"))
    r = r.withColumn("depreciation", F.col("_d.value")).withColumn("servicing", F.col("_s.value")).withColumn("maintenance", F.col("_m.value"))
    return r.withColumn("total", F.col(fuel) + F.col("depreciation") + F.col("servicing") + F.col("maintenance")).drop("_d", "_s", "_m")
