"""Queries of daily telematics, odometers, utilisation, emissions and account figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import emissions, resolve, utilisation
from ..operators import telematics as T
from .base import query
from .fixtures import Fleet
from .scalar import FACTOR, IDLE_RATE

_IDLE = "SELECT asset_id, record_date, sum(duration) / 60e0 AS idle_hours FROM idle_rows WHERE duration IS NOT NULL AND lower(trim(unit)) IN ('', 'min') GROUP BY ALL HAVING sum(duration) > 0"


@query("daily_idle", _IDLE, "idle_hours")
def _(f: Fleet):
    return T.daily_idle(f.idle_rows)


@query("idle_plausibility", f"SELECT asset_id, record_date, CASE WHEN idle_hours <= 24 THEN idle_hours END AS idle_hours, CASE WHEN idle_hours > 24 THEN 'impossible' WHEN idle_hours > 10 THEN 'high' END AS idle_flag FROM ({_IDLE}) x", "idle_hours")
def _(f: Fleet):
    return T.idle_plausibility(T.daily_idle(f.idle_rows))


MILEAGE = "SELECT import_id, user_id, asset_id, record_date, max(distance) AS distance, min(pos) AS first_pos FROM mileage_rows WHERE distance IS NOT NULL GROUP BY ALL HAVING max(distance) > 0"


@query("daily_mileage", MILEAGE, "distance")
def _(f: Fleet):
    return T.daily_mileage(f.mileage_rows)


@query("latest_odometer", "SELECT asset_id, max_by(odometer_km, record_date) AS odometer_km FROM telematics WHERE odometer_km IS NOT NULL GROUP BY asset_id", "odometer_km")
def _(f: Fleet):
    return T.latest_odometer(f.telematics)


@query("latest_engine_hours", "SELECT asset_id, max_by(total_engine_hours, record_date) AS total_engine_hours FROM telematics WHERE total_engine_hours IS NOT NULL GROUP BY asset_id", "total_engine_hours")
def _(f: Fleet):
    return T.latest_engine_hours(f.telematics)


@query("running_odometer", f"""SELECT m.asset_id, record_date, coalesce(nullif(CASE WHEN m.asset_id % 6 = 0 THEN 0e0 WHEN m.asset_id % 6 = 1 THEN NULL ELSE l.odometer_km END, 0e0), a.current_odometer, 0e0)
    + sum(distance) OVER (PARTITION BY m.asset_id ORDER BY import_id % 3, import_id, first_pos ROWS UNBOUNDED PRECEDING) AS odometer_km
  FROM ({MILEAGE}) m LEFT JOIN (SELECT asset_id, max_by(odometer_km, record_date) AS odometer_km FROM telematics WHERE odometer_km IS NOT NULL GROUP BY asset_id) l USING (asset_id) LEFT JOIN assets a USING (asset_id)""", "odometer_km")  # fmt: skip
def _(f: Fleet):
    k = F.col("asset_id") % 6
    tel = f.telematics.withColumn("odometer_km", F.when(k == 0, F.when(F.col("odometer_km").isNotNull(), 0.0)).when(k >= 2, F.col("odometer_km")))
    m = T.daily_mileage(f.mileage_rows).withColumn("received_at", F.col("import_id") % 3)
    return T.running_odometer(m, tel, f.assets).select("asset_id", "record_date", "odometer_km")


@query("clean_exec_summary", """SELECT asset_id, source_id, record_date, CASE WHEN vehicle_name = '' OR total_minutes = 0 THEN 'bad_row' WHEN asset_id IS NULL THEN 'no_asset' END AS reject_reason,
  (total_minutes - coalesce(idle_minutes, 0)) / 60e0 AS operating_hours, coalesce(idle_minutes, 0) / 60e0 AS idle_hours, total_minutes / 60e0 AS total_engine_hours FROM exec_rows""", "operating_hours idle_hours total_engine_hours")  # fmt: skip
def _(f: Fleet):
    rows = T.clean_exec_summary(f.exec_rows.withColumn("import_id", F.col("source_id")))
    return rows.select("asset_id", F.col("import_id").alias("source_id"), "record_date", "reject_reason", "operating_hours", "idle_hours", "total_engine_hours")


@query("exec_odometer", """SELECT e.asset_id, e.record_date, CASE WHEN e.distance > 0 THEN coalesce(CASE WHEN e.asset_id % 4 = 0 THEN NULL WHEN e.asset_id % 4 = 1 THEN 0e0 ELSE l.o END, a.current_odometer) + e.distance END AS odometer_km
  FROM exec_rows e LEFT JOIN (SELECT asset_id, max_by(odometer_km, record_date) AS o FROM telematics WHERE odometer_km IS NOT NULL GROUP BY asset_id) l USING (asset_id) LEFT JOIN assets a USING (asset_id)
  WHERE e.asset_id IS NOT NULL AND vehicle_name <> '' AND total_minutes <> 0""", "odometer_km")  # fmt: skip
def _(f: Fleet):
    k = F.col("asset_id") % 4
    tel = f.telematics.filter(k != 0).withColumn("odometer_km", F.when(k == 1, F.when(F.col("odometer_km").isNotNull(), 0.0)).otherwise(F.col("odometer_km")))
    return T.exec_odometer(T.clean_exec_summary(f.exec_rows).filter("reject_reason is null"), tel, f.assets).select("asset_id", "record_date", "odometer_km")


_OPS = "SELECT asset_id, record_date, sum(coalesce(operating_hours, 0e0)) AS operating_hours FROM telematics GROUP BY ALL"


@query("daily_operating_hours", _OPS, "operating_hours")
def _(f: Fleet):
    return T.daily_operating_hours(f.telematics)


_DAY = """SELECT asset_id, record_date, coalesce(litres, 0e0) AS litres, coalesce(operating_hours, 0e0) AS operating_hours, coalesce(idle_hours, 0e0) AS idle_hours
  FROM (SELECT asset_id, record_date, sum(litres) AS litres FROM fuel_records GROUP BY ALL) a
  FULL JOIN (SELECT asset_id, record_date, sum(operating_hours) AS operating_hours, sum(coalesce(idle_hours, 0e0)) AS idle_hours FROM telematics GROUP BY ALL) b USING (asset_id, record_date)"""


@query("daily_fuel_telematics", _DAY, "litres operating_hours idle_hours")
def _(f: Fleet):
    return T.daily_fuel_telematics(f.fuel_records, f.telematics)


_WINDOW = "SELECT asset_id, min(record_date) AS first_date, max(record_date) AS last_date, count(DISTINCT record_date) AS n_days FROM telematics GROUP BY asset_id"


@query("recorded_window", _WINDOW)
def _(f: Fleet):
    return T.recorded_window(f.telematics)


@query("date_window_filter", "SELECT asset_id, record_date, operating_hours FROM telematics WHERE record_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'", "operating_hours")
def _(f: Fleet):
    return T.date_window(f.telematics, "record_date", "2024-01-05", "2024-01-12").select("asset_id", "record_date", "operating_hours")


@query("fleet_composition", "SELECT user_id, coalesce(bool_or(asset_type IN ('Light Vehicle', 'Rigid Truck', 'Semi Trailer')), false) AS has_trucks, coalesce(bool_or(asset_type NOT IN ('Light Vehicle', 'Rigid Truck', 'Semi Trailer')), false) AS has_machinery FROM assets GROUP BY user_id")
def _(f: Fleet):
    return T.fleet_composition(f.assets)


@query("billing_quantities", """SELECT user_id, trucks, machines, trucks + machines >= 10 AS invoice_eligible, 49e0 + 8e0 * trucks + 15e0 * machines AS monthly_fee FROM (
  SELECT user_id, count(*) FILTER (coalesce(asset_type IN ('Light Vehicle', 'Rigid Truck', 'Semi Trailer'), false)) AS trucks, count(*) FILTER (NOT coalesce(asset_type IN ('Light Vehicle', 'Rigid Truck', 'Semi Trailer'), false)) AS machines FROM assets WHERE NOT is_ignored GROUP BY user_id) x""")  # fmt: skip
def _(f: Fleet):
    return T.billing_quantities(f.assets)


PRICE = "SELECT vehicle_id AS asset_id, sum(cost_nzd) / nullif(sum(litres), 0) AS avg_cost_per_litre FROM fuel_purchases GROUP BY vehicle_id"


@query("avg_cost_per_litre", f"SELECT a.asset_id, avg_cost_per_litre, p.asset_id IS NOT NULL AS fuel_pricing_available FROM assets a LEFT JOIN ({PRICE}) p ON a.asset_id = p.asset_id", "avg_cost_per_litre")
def _(f: Fleet):
    return T.avg_cost_per_litre(f.assets, f.fuel_purchases)


_PERIOD = f"""SELECT w.*, coalesce(available_hours_per_week, 40e0) * greatest(last_date - first_date + 1, 1) / 7e0 AS period_available, target_utilisation_percent AS target,
  greatest((SELECT count(*) FROM (SELECT unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS d) y WHERE isodow(d) < 6), 1) AS working_days FROM ({_WINDOW}) w JOIN assets USING (asset_id)"""
UTILISATION = f"""SELECT asset_id, record_date, available_hours, actual_hours, rate, target, CASE WHEN NOT has_row THEN 'no-data' WHEN available_hours <= 0 AND actual_hours > 0 THEN 'exceeds-capacity' WHEN target IS NULL THEN 'no-target'
    WHEN rate > 100 THEN 'exceeds-capacity' WHEN rate >= target THEN 'on-target' ELSE 'below-target' END AS status
  FROM (SELECT *, CASE WHEN available_hours > 0 THEN actual_hours / available_hours * 100e0 END AS rate FROM (
    SELECT d.asset_id, d.record_date, d.target, CASE WHEN isodow(d.record_date) < 6 THEN period_available / working_days ELSE 0e0 END AS available_hours, coalesce(o.operating_hours, 0e0) AS actual_hours, o.asset_id IS NOT NULL AS has_row
    FROM (SELECT *, cast(unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS date) AS record_date FROM ({_PERIOD}) p) d LEFT JOIN ({_OPS}) o ON o.asset_id = d.asset_id AND o.record_date = d.record_date) x) y"""


@query("utilisation_daily", UTILISATION, "available_hours actual_hours rate target")
def _(f: Fleet):
    return utilisation.utilisation_daily(f.assets, f.telematics)


@query("utilisation_status", f"SELECT status, count(*) AS days FROM ({UTILISATION}) u GROUP BY status")
def _(f: Fleet):
    return utilisation.utilisation_daily(f.assets, f.telematics).groupBy("status").agg(F.count("*").alias("days"))


@query("utilisation_kpis", f"""SELECT asset_id, period_available AS available_hours, actual_hours, CASE WHEN period_available > 0 THEN actual_hours / period_available * 100e0 END AS rate, target, CASE WHEN period_available > 0 THEN actual_hours / period_available * 100e0 END - target AS variance
  FROM ({_PERIOD}) p JOIN (SELECT asset_id, sum(operating_hours) AS actual_hours FROM telematics GROUP BY asset_id) t USING (asset_id)""", "available_hours actual_hours rate target variance")  # fmt: skip
def _(f: Fleet):
    return utilisation.utilisation_kpis(f.assets, f.telematics)


@query("sparse_window_note", f"SELECT asset_id, NOT (DATE '2024-01-02' >= first_date AND DATE '2024-02-05' <= last_date) AND (35 > (last_date - first_date + 1) * 1.25 OR 35 - (last_date - first_date + 1) >= 14) AS sparse FROM ({_WINDOW}) w")
def _(f: Fleet):
    short = T.recorded_window(f.telematics)
    return utilisation.sparse_window_note(short, "2024-01-02", "2024-02-05").select("asset_id", "sparse")


EMISSIONS = f"""SELECT asset_id, record_date, asset_name, litres, operating_hours, idle_hours, least(idle_hours * r, litres) AS idle_litres, litres - least(idle_hours * r, litres) AS operating_litres,
  (litres - least(idle_hours * r, litres)) * f AS operating_kg, least(idle_hours * r, litres) * f AS idle_kg, litres * f AS kg, sum(litres * f) OVER (PARTITION BY asset_id ORDER BY record_date ROWS UNBOUNDED PRECEDING) AS cumulative_kg
  FROM ({_DAY}) d JOIN (SELECT asset_id, asset_name, {IDLE_RATE} AS r, {FACTOR} AS f FROM assets) a USING (asset_id)"""
_KG = "litres operating_hours idle_hours idle_litres operating_litres operating_kg idle_kg kg cumulative_kg"


@query("emissions_daily", EMISSIONS, _KG)
def emissions_daily(f: Fleet):
    return emissions.emissions_daily(f.assets, f.fuel_records, f.telematics)


@query("cumulative_co2", f"SELECT asset_id, record_date, cumulative_kg FROM ({EMISSIONS}) e", "cumulative_kg")
def _(f: Fleet):
    return emissions_daily(f).select("asset_id", "record_date", "cumulative_kg")


@query("emissions_kpis", f"""SELECT asset_id, sum(litres) AS litres, sum(operating_kg) AS operating_kg, sum(idle_kg) AS idle_kg, sum(kg) / 1000e0 AS tonnes, CASE WHEN sum(operating_hours) > 0 THEN sum(kg) / sum(operating_hours) ELSE 0e0 END AS kg_per_operating_hour
  FROM ({EMISSIONS}) e GROUP BY asset_id""", "litres operating_kg idle_kg tonnes kg_per_operating_hour", 8)  # fmt: skip
def _(f: Fleet):
    return emissions.emissions_kpis(emissions_daily(f))


@query("resolve_account", "SELECT user_id, coalesce(account_owner_user_id, user_id) AS account_id FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN members m ON e.user_id = m.member_auth_user_id")
def _(f: Fleet):
    return resolve.resolve_account(f.table("events").select("user_id").distinct(), f.members)


@query("route_import_to_account", """SELECT import_id, s.user_id AS account_id FROM imports i JOIN settings s ON s.upload_email = split_part(lower(trim(replace(replace(replace(to_email, 'Upload ', ''), '<', ''), '>', ''))), '@', 1)""")
def _(f: Fleet):
    return resolve.route_imports(f.imports, f.settings).select("import_id", "account_id")


@query("unrouted_imports", """SELECT import_id FROM imports WHERE split_part(lower(trim(replace(replace(replace(to_email, 'Upload ', ''), '<', ''), '>', ''))), '@', 1) NOT IN (SELECT upload_email FROM settings)""")
def _(f: Fleet):
    return resolve.unrouted_imports(f.imports, f.settings).select("import_id")


@query("active_assets", "SELECT asset_id, asset_name FROM assets WHERE NOT is_ignored")
def _(f: Fleet):
    return resolve.active_assets(f.assets).select("asset_id", "asset_name")
