"""Queries of the asset cost model and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costs
from ..operators import reports as R
from ..operators.telematics import latest_engine_hours
from .base import query
from .calibration import _MERGED, merged
from .daily import EMISSIONS, PRICE
from .fixtures import Fleet
from .scalar import IDLE_RATE

_ROAD = "coalesce(is_on_road, coalesce(asset_type IN ('Light Vehicle', 'Rigid Truck', 'Semi Trailer'), false))"
_HOURS = "SELECT asset_id, max_by(total_engine_hours, record_date) AS eng FROM telematics WHERE total_engine_hours IS NOT NULL GROUP BY asset_id"
#: ca: assets with each rate as (x_ok, x_value); missing lists joined by '|'; and life flags.
_CA = f"""ca0 AS (SELECT a.*, h.eng, {_ROAD} AS road FROM assets a LEFT JOIN ({_HOURS}) h ON h.asset_id = a.asset_id),
  ca1 AS (SELECT *,
    concat_ws('|', CASE WHEN current_value IS NULL THEN 'Current Value' END, CASE WHEN estimated_end_of_life_value IS NULL THEN 'Estimated End of Life Value' END,
      CASE WHEN road AND expected_life_km IS NULL THEN 'Expected Total Life (km)' END, CASE WHEN road AND current_odometer IS NULL THEN 'Current Odometer (km)' END,
      CASE WHEN NOT road AND expected_life_hours IS NULL THEN 'Expected Total Life (hours)' END, CASE WHEN NOT road AND eng IS NULL THEN 'Total Engine Hours' END) AS dep_missing,
    concat_ws('|', CASE WHEN estimated_annual_repair_cost IS NULL THEN 'Estimated Annual Repair Cost' END, CASE WHEN road AND estimated_annual_km IS NULL THEN 'Estimated Annual KM' END,
      CASE WHEN NOT road AND available_hours_per_week IS NULL THEN 'Available Hours Per Week' END, CASE WHEN NOT road AND target_utilisation_percent IS NULL THEN 'Target Utilisation Percent' END) AS maint_missing0,
    CASE WHEN road THEN CASE WHEN service_cost_per_km IS NULL THEN 'Service Cost Per KM' ELSE '' END ELSE CASE WHEN service_cost_per_hour IS NULL THEN 'Service Cost Per Hour' ELSE '' END END AS serv_missing,
    CASE WHEN road THEN expected_life_km - current_odometer ELSE expected_life_hours - eng END AS remaining,
    CASE WHEN road THEN greatest(expected_life_km * 0.02e0, 100e0) ELSE greatest(expected_life_hours * 0.02e0, 5e0) END AS floor_,
    CASE WHEN road THEN estimated_annual_km ELSE available_hours_per_week * 52 * (target_utilisation_percent / 100e0) END AS usage_ FROM ca0),
  ca2 AS (SELECT *, CASE WHEN maint_missing0 = '' AND usage_ <= 0 THEN CASE WHEN road THEN 'Estimated Annual KM' ELSE 'estimated annual usage (set Available Hours Per Week and Target Utilisation Percent)' END ELSE maint_missing0 END AS maint_missing,
    dep_missing = '' AND remaining <= floor_ AS life_exceeded, dep_missing = '' AND remaining <= floor_ AND remaining > 0 AS life_near_limit FROM ca1),
  ca AS (SELECT *, CASE WHEN dep_missing = '' AND NOT life_exceeded THEN greatest((current_value - estimated_end_of_life_value) / remaining, 0e0) END AS dep, CASE WHEN maint_missing = '' THEN estimated_annual_repair_cost / usage_ END AS maint,
    CASE WHEN road THEN service_cost_per_km ELSE service_cost_per_hour END AS serv FROM ca2)"""


def _assets(f: Fleet):
    return f.assets.join(latest_engine_hours(f.telematics), "asset_id", "left")


def _rates(f: Fleet):
    return costs.with_rates(_assets(f))


@query("missing_fields", f"WITH {_CA} SELECT asset_id, dep_missing, maint_missing0 AS maint_missing, serv_missing FROM ca")
def _(f: Fleet):
    hours, none = F.col("total_engine_hours"), F.lit(None).cast("double")
    return _assets(f).select("asset_id", F.array_join(costs.missing_depreciation(hours, none), "|").alias("dep_missing"), F.array_join(costs.missing_maintenance(), "|").alias("maint_missing"), F.array_join(costs.missing_servicing(), "|").alias("serv_missing"))


def _dep(f: Fleet, road: bool, name: str):
    d = F.col("dep_km" if road else "dep_hour")
    return _rates(f).filter(F.col("on_road") if road else ~F.col("on_road")).select("asset_id", d["value"].alias(name), F.array_join(d["missing"], "|").alias("missing"), d["life_exceeded"].alias("life_exceeded"), d["life_near_limit"].alias("life_near_limit"))


@query("depreciation_per_hour", f"WITH {_CA} SELECT asset_id, dep AS per_hour, dep_missing AS missing, life_exceeded, life_near_limit FROM ca WHERE NOT road", "per_hour")
def _(f: Fleet):
    return _dep(f, False, "per_hour")


@query("depreciation_per_km", f"WITH {_CA} SELECT asset_id, dep AS per_km, dep_missing AS missing, life_exceeded, life_near_limit FROM ca WHERE road", "per_km")
def _(f: Fleet):
    return _dep(f, True, "per_km")


@query("maintenance_per_hour", f"WITH {_CA} SELECT asset_id, maint AS per_hour, maint_missing AS missing FROM ca WHERE NOT road", "per_hour")
def _(f: Fleet):
    return _rates(f).filter(~F.col("on_road")).select("asset_id", F.col("maint_hour.value").alias("per_hour"), F.array_join("maint_hour.missing", "|").alias("missing"))


@query("maintenance_per_km", f"WITH {_CA} SELECT asset_id, maint AS per_km, maint_missing AS missing FROM ca WHERE road", "per_km")
def _(f: Fleet):
    return _rates(f).filter("on_road").select("asset_id", F.col("maint_km.value").alias("per_km"), F.array_join("maint_km.missing", "|").alias("missing"))


@query("servicing_rate", f"WITH {_CA} SELECT asset_id, road AS on_road, serv AS rate, serv_missing AS missing FROM ca", "rate")
def _(f: Fleet):
    return _rates(f).select("asset_id", "on_road", F.col("serv.value").alias("rate"), F.array_join("serv.missing", "|").alias("missing"))


_LIFE = "CASE WHEN road THEN CASE WHEN expected_life_km > 0 THEN current_odometer / expected_life_km END ELSE CASE WHEN expected_life_hours > 0 THEN eng / expected_life_hours END END"


@query("life_usage", f"WITH {_CA} SELECT asset_id, {_LIFE} AS ratio, coalesce({_LIFE} >= 0.9e0, false) AS approaching FROM ca", "ratio")
def _(f: Fleet):
    ratio = costs.life_usage(F.col("total_engine_hours"), F.lit(None).cast("double"))
    return _assets(f).select("asset_id", ratio.alias("ratio"), costs.approaching_life(ratio).alias("approaching"))


_IC = f"""{_CA}, tel AS (SELECT asset_id, sum(operating_hours) AS oh, sum(coalesce(idle_hours, 0e0)) AS ih FROM telematics GROUP BY asset_id),
  ic0 AS (SELECT ca.*, oh, ih, p.asset_id IS NOT NULL AS priced, coalesce(avg_cost_per_litre, 0e0) AS price, {IDLE_RATE} AS idle_rate FROM ca JOIN tel USING (asset_id) LEFT JOIN ({PRICE}) p ON p.asset_id = ca.asset_id),
  ic AS (SELECT *, CASE WHEN priced THEN ih * idle_rate * price END AS fuel, CASE WHEN road THEN dep * 0 ELSE ih * dep END AS c_dep, CASE WHEN road THEN serv * 0 ELSE ih * serv END AS c_serv, CASE WHEN road THEN maint * 0 ELSE ih * maint END AS c_maint FROM ic0)"""


@query("idle_hour_costs", f"""WITH {_IC} SELECT asset_id, fuel, c_dep AS depreciation, c_serv AS servicing, c_maint AS maintenance, coalesce(fuel, 0e0) + coalesce(c_dep, 0e0) + coalesce(c_serv, 0e0) + coalesce(c_maint, 0e0) AS total,
  NOT (priced AND dep IS NOT NULL AND serv IS NOT NULL AND maint IS NOT NULL) AS has_missing FROM ic""", "fuel depreciation servicing maintenance total")  # fmt: skip
def _(f: Fleet):
    c = costs.idle_hour_costs(R.with_idle_inputs(f.assets, f.telematics, f.fuel_purchases))
    return c.select("asset_id", "fuel", "depreciation", "servicing", "maintenance", "total", "has_missing")


@query("running_cost_per_km", f"WITH {_CA} SELECT asset_id, asset_id / 100e0 AS fuel_per_km, dep AS depreciation, serv AS servicing, maint AS maintenance, asset_id / 100e0 + dep + serv + maint AS total FROM ca WHERE road", "fuel_per_km depreciation servicing maintenance total")
def _(f: Fleet):
    a = f.assets.filter(costs.on_road()).withColumn("fuel_per_km", F.col("asset_id") / 100)
    return costs.running_cost_per_km(a).select("asset_id", "fuel_per_km", "depreciation", "servicing", "maintenance", "total")


@query("fuel_daily_split", f"SELECT e.asset_id, record_date, operating_litres, idle_litres, CASE WHEN operating_hours > 0 THEN operating_litres / operating_hours END AS operating_lph, CASE WHEN idle_hours > 0 THEN idle_litres / idle_hours END AS idle_lph FROM ({EMISSIONS}) e JOIN assets a ON a.asset_id = e.asset_id WHERE NOT {_ROAD}", "operating_litres idle_litres operating_lph idle_lph")
def _(f: Fleet):
    return R.fuel_daily_split(f.assets, f.fuel_records, f.telematics)


@query("machine_fuel_cost", f"SELECT t.asset_id, record_date, litres_consumed, litres_consumed * machinery_fuel_cost_per_litre AS fuel_cost FROM telematics t JOIN assets a ON a.asset_id = t.asset_id LEFT JOIN settings s ON s.user_id = a.user_id WHERE NOT {_ROAD}", "litres_consumed fuel_cost")
def _(f: Fleet):
    return R.machine_fuel_cost(f.telematics, f.assets, f.settings)


_FF = f"""{_MERGED}, ff AS (SELECT g.asset_id, period_start, km, litres, CASE WHEN km > 0 THEN litres * 100e0 / km END AS litres_per_100km, CASE WHEN km > 0 THEN litres * avg_cost_per_litre / km END AS fuel_per_km
  FROM (SELECT asset_id, cast(date_trunc('month', end_date) AS date) AS period_start, sum(distance_km) AS km, sum(litres) AS litres FROM merged WHERE included GROUP BY ALL) g LEFT JOIN ({PRICE}) p ON p.asset_id = g.asset_id)"""


@query("fill_to_fill_fuel", f"WITH {_FF} SELECT * FROM ff", "km litres litres_per_100km fuel_per_km")
def fill_to_fill(f: Fleet):
    return R.fill_to_fill_fuel(merged(f), f.fuel_purchases)


@query("ruc_rate", "SELECT asset_id, gvm_tonnes, rate_per_km AS ruc_per_km FROM assets LEFT JOIN ruc_rates ON gvm_tonnes >= gvm_lo AND gvm_tonnes < gvm_hi", "gvm_tonnes ruc_per_km")
def _(f: Fleet):
    return R.ruc_rate(f.assets, f.ruc_rates).select("asset_id", "gvm_tonnes", "ruc_per_km")


@query("cost_per_km_report", f"""WITH {_FF}, {_CA} SELECT ff.asset_id, period_start, km, litres, fuel_per_km, dep AS depreciation, maint AS maintenance, serv AS servicing, rate_per_km AS ruc_per_km, fuel_per_km + dep + serv + maint + coalesce(rate_per_km, 0e0) AS total_per_km,
  (fuel_per_km + dep + serv + maint + coalesce(rate_per_km, 0e0)) / gvm_tonnes AS per_tonne_km FROM ff JOIN ca USING (asset_id) LEFT JOIN ruc_rates ON gvm_tonnes >= gvm_lo AND gvm_tonnes < gvm_hi WHERE road""", "km litres fuel_per_km depreciation maintenance servicing ruc_per_km total_per_km per_tonne_km")  # fmt: skip
def _(f: Fleet):
    return R.cost_per_km_report(f.assets, fill_to_fill(f), f.ruc_rates)


_IR = f"""{_IC}, ir AS (SELECT asset_id, user_id, asset_name, oh + ih AS engine_hours, oh AS operating_hours, ih AS idle_hours, CASE WHEN oh + ih > 0 THEN ih * 100e0 / (oh + ih) END AS idle_percent, fuel AS idle_fuel_cost,
  coalesce(fuel, 0e0) + coalesce(c_dep, 0e0) + coalesce(c_serv, 0e0) + coalesce(c_maint, 0e0) AS total FROM ic)"""


@query("idle_cost_report", f"WITH {_IR} SELECT *, CASE WHEN total > 0 THEN idle_fuel_cost * 100e0 / total END AS fuel_percent_of_total FROM ir", "engine_hours operating_hours idle_hours idle_percent idle_fuel_cost total fuel_percent_of_total")
def idle_report(f: Fleet):
    return R.idle_cost_report(f.assets, f.telematics, f.fuel_purchases)


@query("idle_offenders_top_k", f"WITH {_IR} SELECT user_id, asset_id, idle_fuel_cost, row_number() OVER (PARTITION BY user_id ORDER BY idle_fuel_cost DESC NULLS LAST, asset_id) AS rank FROM ir QUALIFY rank <= 5", "idle_fuel_cost")
def _(f: Fleet):
    return R.idle_offenders(idle_report(f))


@query("job_cost_report", f"""WITH {_CA}, per AS (SELECT job_id, j.asset_id, count(DISTINCT work_date) AS days_worked, sum(coalesce(t.operating_hours, 0e0)) AS operating_hours, sum(coalesce(t.idle_hours, 0e0)) AS ih, sum(coalesce(bought, 0e0)) AS bought, sum(tonnes) AS tonnes
    FROM jobs j LEFT JOIN telematics t ON t.asset_id = j.asset_id AND t.record_date = j.work_date LEFT JOIN (SELECT vehicle_id, purchase_date, sum(cost_nzd) AS bought FROM fuel_purchases GROUP BY ALL) b ON b.vehicle_id = j.asset_id AND b.purchase_date = j.work_date GROUP BY job_id, j.asset_id),
  r0 AS (SELECT job_id, per.asset_id, days_worked, operating_hours, tonnes, bought, ih * {IDLE_RATE} * coalesce(avg_cost_per_litre, 0e0) AS idle_cost, CASE WHEN road THEN 0e0 ELSE coalesce(operating_hours * dep, 0e0) END AS depreciation, CASE WHEN road THEN 0e0 ELSE coalesce(operating_hours * serv, 0e0) END AS servicing,
    CASE WHEN road THEN 0e0 ELSE coalesce(operating_hours * maint, 0e0) END AS maintenance FROM per JOIN ca ON ca.asset_id = per.asset_id LEFT JOIN ({PRICE}) p ON p.asset_id = per.asset_id),
  r1 AS (SELECT *, greatest(bought - idle_cost, 0e0) AS fuel_cost, greatest(bought - idle_cost, 0e0) + idle_cost + depreciation + servicing + maintenance AS total FROM r0)
  SELECT job_id, asset_id, cast(sum(days_worked) AS bigint) AS days_worked, sum(operating_hours) AS operating_hours, sum(tonnes) AS tonnes, sum(fuel_cost) AS fuel_cost, sum(idle_cost) AS idle_cost, sum(depreciation) AS depreciation, sum(servicing) AS servicing, sum(maintenance) AS maintenance, sum(total) AS total,
    CASE WHEN sum(operating_hours) > 0 THEN sum(total) / sum(operating_hours) END AS cost_per_operating_hour, CASE WHEN sum(tonnes) > 0 THEN sum(total) / sum(tonnes) END AS cost_per_tonne FROM r1 GROUP BY GROUPING SETS ((job_id, asset_id), (job_id))""", "operating_hours tonnes fuel_cost idle_cost depreciation servicing maintenance total cost_per_operating_hour cost_per_tonne", 8)  # fmt: skip
def _(f: Fleet):
    return R.job_cost_report(f.jobs, f.assets, f.telematics, f.fuel_purchases)


@query("trip_report", f"""WITH {_FF}, {_CA}, od AS (SELECT trip_id, (SELECT min_by(odometer_km, record_date) FROM telematics t WHERE t.asset_id = x.asset_id AND odometer_km IS NOT NULL AND record_date BETWEEN start_date AND start_date + 3) AS o1,
    (SELECT max_by(odometer_km, record_date) FROM telematics t WHERE t.asset_id = x.asset_id AND odometer_km IS NOT NULL AND record_date BETWEEN end_date - 3 AND end_date) AS o2 FROM trips x),
  fr AS (SELECT asset_id, sum(litres) / sum(km) AS lpk, sum(fuel_per_km * km) / sum(km) AS fpk FROM ff GROUP BY asset_id),
  tr AS (SELECT x.trip_id, x.asset_id, payload_tonnes, CASE WHEN o2 > o1 THEN o2 - o1 END AS d, fpk, lpk, CASE WHEN dk_missing OR dk_rem <= greatest(expected_life_km * 0.02e0, 100e0) THEN NULL ELSE greatest((current_value - estimated_end_of_life_value) / dk_rem, 0e0) END AS depk, mk, sk FROM trips x JOIN od USING (trip_id)
    LEFT JOIN fr ON fr.asset_id = x.asset_id JOIN (SELECT *, dep_missing <> '' AND road OR NOT road AND dep_missing <> '' AS dk_missing, expected_life_km - current_odometer AS dk_rem, CASE WHEN maint_missing0 = '' AND estimated_annual_km > 0 THEN estimated_annual_repair_cost / estimated_annual_km END AS mk, CASE WHEN serv_missing = '' THEN service_cost_per_km END AS sk FROM ca) c ON c.asset_id = x.asset_id WHERE road)
  SELECT trip_id, asset_id, d AS distance_km, d * fpk AS fuel_cost, d * depk AS depreciation_cost, d * mk AS maintenance_cost, d * sk AS servicing_cost, d * (fpk + depk + sk + mk) AS total_cost, CASE WHEN d > 0 THEN fpk + depk + sk + mk END AS cost_per_km, payload_tonnes, (fpk + depk + sk + mk) / payload_tonnes AS cost_per_tonne_km, d * lpk * 2.680680605e0 AS emissions_kg FROM tr""",
    "distance_km fuel_cost depreciation_cost maintenance_cost servicing_cost total_cost cost_per_km payload_tonnes cost_per_tonne_km emissions_kg")
def _(f: Fleet):
    return R.trip_report(f.trips, f.assets.filter(costs.on_road()), f.telematics, fill_to_fill(f))


@query("emissions_report", f"WITH {_FF} SELECT ff.asset_id, period_start, litres, km, litres * 2.680680605e0 AS kg, CASE WHEN km > 0 THEN litres * 2.680680605e0 / km END AS kg_per_km, CASE WHEN km * gvm_tonnes > 0 THEN litres * 2.680680605e0 / (km * gvm_tonnes) END AS kg_per_tonne_km FROM ff LEFT JOIN assets a ON a.asset_id = ff.asset_id", "litres km kg kg_per_km kg_per_tonne_km")
def _(f: Fleet):
    return R.emissions_report(fill_to_fill(f), f.assets)
