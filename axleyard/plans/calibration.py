"""Queries of intervals and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..operators import calibrate as K
from ..operators import intervals as I
from ..tables import cut
from .base import query
from .fixtures import Fleet

_FILLS = "fills AS (SELECT vehicle_id AS asset_id, purchase_date, litres, row_number() OVER (PARTITION BY vehicle_id ORDER BY purchase_date, litres, cost_nzd) AS seq FROM fuel_purchases)"
_IV = f"{_FILLS}, iv AS (SELECT * FROM (SELECT asset_id, seq, lag(purchase_date) OVER (PARTITION BY asset_id ORDER BY seq) AS start_date, purchase_date AS end_date, litres FROM fills) x WHERE seq > 1)"
_ODO = """odo AS (SELECT asset_id, record_date, odometer_km FROM telematics WHERE odometer_km IS NOT NULL),
  so AS (SELECT asset_id, seq, min_by(odometer_km, record_date) AS start_odo FROM iv JOIN odo USING (asset_id) WHERE record_date BETWEEN start_date AND start_date + 3 GROUP BY ALL),
  eo AS (SELECT asset_id, seq, max_by(odometer_km, record_date) AS end_odo FROM iv JOIN odo USING (asset_id) WHERE record_date BETWEEN end_date - 3 AND end_date GROUP BY ALL)"""
_DAYS = """dys AS (SELECT asset_id, seq, cast(unnest(generate_series(start_date, end_date - 1, INTERVAL 1 DAY)) AS date) AS record_date FROM iv WHERE end_date > start_date),
  dj AS (SELECT d.asset_id, d.seq, d.record_date, t.asset_id IS NOT NULL AS has_row, t.odometer_km, t.idle_hours FROM dys d LEFT JOIN telematics t ON t.asset_id = d.asset_id AND t.record_date = d.record_date),
  wd AS (SELECT * FROM dj WHERE isodow(record_date) < 6 AND record_date NOT IN (SELECT holiday_date FROM holidays))"""


def _run(name: str, missing: str, out: str) -> str:
    return f"""{name} AS (SELECT asset_id, seq, max(n) AS {out} FROM (SELECT asset_id, seq, island, count(*) AS n FROM (SELECT asset_id, seq, sum(new) OVER (PARTITION BY asset_id, seq ORDER BY record_date) AS island FROM (
      SELECT asset_id, seq, record_date, CASE WHEN record_date - lag(record_date) OVER (PARTITION BY asset_id, seq ORDER BY record_date) <= 3 THEN 0 ELSE 1 END AS new FROM wd WHERE {missing}) a) b GROUP BY ALL) c GROUP BY ALL)"""


_RUNS = _run("mr", "NOT has_row", "max_missing_run") + ", " + _run("orun", "has_row AND odometer_km IS NULL", "max_odometer_run")
_EV = f"""{_IV}, {_ODO}, {_DAYS}, {_RUNS}, idle AS (SELECT asset_id, seq, sum(coalesce(idle_hours, 0e0)) AS idle_hours FROM dj GROUP BY ALL),
  ev0 AS (SELECT iv.*, end_odo - start_odo AS distance_km, coalesce(idle_hours, 0e0) AS idle_hours, max_missing_run, max_odometer_run FROM iv LEFT JOIN so USING (asset_id, seq) LEFT JOIN eo USING (asset_id, seq) LEFT JOIN idle USING (asset_id, seq) LEFT JOIN mr USING (asset_id, seq) LEFT JOIN orun USING (asset_id, seq)),
  ev AS (SELECT asset_id, seq, start_date, end_date, distance_km, litres, idle_hours, exclusion_reason IS NULL AS included, exclusion_reason FROM (SELECT *, CASE WHEN distance_km IS NULL THEN 'missing_odometer_boundary' WHEN distance_km <= 0 THEN 'non_positive_distance'
    WHEN max_missing_run >= 2 THEN 'telematics_gap' WHEN max_odometer_run >= 2 THEN 'odometer_gap' WHEN litres IS NULL OR litres <= 0 THEN 'invalid_litres' WHEN litres < 3 THEN 'implausible_litres' END AS exclusion_reason FROM ev0) x)"""
_MERGED = f"""{_EV}, ch AS (SELECT *, coalesce(lag(exclusion_reason) OVER w = 'non_positive_distance', false) AS aft, lead(seq) OVER w AS nxt FROM ev WINDOW w AS (PARTITION BY asset_id ORDER BY seq)),
  cg AS (SELECT *, sum(CASE WHEN aft THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY seq) AS g FROM ch),
  merged AS (SELECT asset_id, seq, start_date, end_date, distance_km, CASE WHEN aft THEN sum(coalesce(litres, 0e0)) OVER (PARTITION BY asset_id, g ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE litres END AS litres, idle_hours, included,
    CASE WHEN exclusion_reason = 'non_positive_distance' AND nxt IS NOT NULL THEN 'non_positive_distance_litres_merged_forward' ELSE exclusion_reason END AS exclusion_reason FROM cg)"""
MERGED = f"WITH {_MERGED} "
#: Cuts binary noise: both sides must agree which of the two sides of a threshold a sum falls on.
_CAL = f"""{_MERGED}, reg AS (SELECT asset_id, count(*) AS n, sum(distance_km * litres) AS sxy, sum(distance_km * distance_km) AS sxx, sum(litres * litres) AS syy, sum(litres) AS l, sum(distance_km) AS km, sum(idle_hours) AS ih FROM merged WHERE included GROUP BY asset_id),
  slopes AS (SELECT *, greatest(CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0e0 END, 0e0) AS slope FROM reg),
  cal AS (SELECT asset_id, coalesce(n, 0) >= 6 AS calibrated, CASE WHEN coalesce(n, 0) < 6 THEN 'insufficient_intervals' END AS reason, coalesce(n, 0) AS included_count, CASE WHEN n >= 6 THEN rate END AS travel_rate_lpk, CASE WHEN n >= 6 THEN slope END AS raw_rate,
      coalesce(n >= 6 AND prev > 0 AND (slope < prev * 0.7e0 OR slope > prev * 1.3e0), false) AS was_capped, CASE WHEN n >= 6 AND syy > 0 THEN 1 - greatest(syy - 2 * slope * sxy + slope * slope * sxx, 0e0) / syy END AS r2,
      CASE WHEN n >= 6 AND ih > 0 THEN greatest(l - rate * km, 0e0) / ih END AS idle_rate_lph, CASE WHEN coalesce(n, 0) < 6 THEN false ELSE l - rate * km < 0 END AS idle_rate_floor_triggered
    FROM (SELECT m.asset_id, s.* EXCLUDE (asset_id), a.travel_rate_lpk AS prev, CASE WHEN a.travel_rate_lpk > 0 THEN least(greatest(slope, a.travel_rate_lpk * 0.7e0), a.travel_rate_lpk * 1.3e0) ELSE slope END AS rate
      FROM (SELECT DISTINCT asset_id FROM merged) m LEFT JOIN slopes s ON s.asset_id = m.asset_id LEFT JOIN assets a ON a.asset_id = m.asset_id) x),
  odd AS (SELECT cal.*, coalesce(a.idle_burn_rate_lph > 0 AND (idle_rate_lph - a.idle_burn_rate_lph) / nullif(a.idle_burn_rate_lph, 0) > 0.5e0 AND NOT coalesce(a.idle_anomaly_confirmed, false), false) AS anomalous FROM cal LEFT JOIN assets a USING (asset_id))"""
_CLASS = "CASE WHEN regexp_matches(lower(asset_name), 'crane|bucket') THEN 'pto_heavy' WHEN regexp_matches(lower(asset_name), '\\bute\\b|ranger|hilux|navara|triton|honda|civic|corolla') THEN 'light_vehicle' ELSE 'standard_truck' END"
_POOL = f"""{_MERGED}, el AS (SELECT m.*, a.user_id, a.travel_rate_lpk, {_CLASS} AS idle_class FROM (SELECT *, count(*) OVER (PARTITION BY asset_id) AS n FROM merged WHERE included) m JOIN assets a USING (asset_id) WHERE n >= 6 AND NOT a.is_ignored),
  c0 AS (SELECT user_id, k AS idle_class, prior AS class_rate, lo, hi, false AS done FROM (SELECT DISTINCT user_id FROM el) u, (VALUES ('pto_heavy', 1.8e0, 1.2e0, 8e0), ('light_vehicle', 1e0, 0.5e0, 2e0), ('standard_truck', 2e0, 1.3e0, 4.5e0)) v(k, prior, lo, hi)),
  t0 AS (SELECT DISTINCT user_id, asset_id, idle_class, cast(NULL AS double) AS travel_rate FROM el)"""
for _i in range(1, S.POOLED_ROUNDS + 1):
    _POOL += f""",
  t{_i} AS MATERIALIZED (SELECT p.user_id, p.asset_id, p.idle_class, CASE WHEN any_value(c.done) THEN any_value(p.travel_rate) ELSE greatest(CASE WHEN sum(distance_km * distance_km) > 0 THEN sum(distance_km * greatest(litres - class_rate * idle_hours, 0e0)) / sum(distance_km * distance_km) ELSE 0e0 END, 0e0) END AS travel_rate
    FROM el e JOIN c{_i - 1} c USING (user_id, idle_class) JOIN t{_i - 1} p ON p.asset_id = e.asset_id GROUP BY p.user_id, p.asset_id, p.idle_class),
  x{_i} AS MATERIALIZED (SELECT c.user_id, c.idle_class, lo, hi, c.done, c.class_rate, CASE WHEN c.done OR d.den IS NULL THEN c.class_rate ELSE least(greatest(CASE WHEN den > 0 THEN num / den ELSE 0e0 END, lo), hi) END AS fresh
    FROM c{_i - 1} c LEFT JOIN (SELECT e.user_id, e.idle_class, sum(idle_hours * (litres - travel_rate * distance_km)) AS num, sum(idle_hours * idle_hours) AS den FROM el e JOIN t{_i} t ON t.asset_id = e.asset_id GROUP BY ALL) d ON d.user_id = c.user_id AND d.idle_class = c.idle_class),
  c{_i} AS MATERIALIZED (SELECT user_id, idle_class, fresh AS class_rate, lo, hi, done OR max(abs(fresh - class_rate)) OVER (PARTITION BY user_id) < 0.01e0 AS done FROM x{_i})"""
_LAST = S.POOLED_ROUNDS
_LOO = """SELECT asset_id, user_id, quantile_cont(CASE WHEN n >= 3 AND litres > 0 THEN abs(greatest(CASE WHEN sxx - distance_km * distance_km > 0 THEN (sxy - distance_km * y) / (sxx - distance_km * distance_km) ELSE 0e0 END, 0e0) * distance_km + fixed - litres) / litres * 100e0 END, 0.5) AS loo
  FROM (SELECT *, sum(distance_km * y) OVER (PARTITION BY asset_id) AS sxy, sum(distance_km * distance_km) OVER (PARTITION BY asset_id) AS sxx FROM (SELECT *, {y} AS y, {fixed} AS fixed FROM {rows}) a) b GROUP BY ALL"""


def _evaluated(f: Fleet):
    return I.evaluate_intervals(f.fuel_purchases, f.telematics, f.holidays)


def merged(f: Fleet):
    return I.merge_orphaned_litres(_evaluated(f))


@query("build_intervals", f"WITH {_IV} SELECT * FROM iv", "litres")
def _(f: Fleet):
    return I.build_intervals(f.fuel_purchases)


_POINTS = "SELECT DISTINCT vehicle_id AS asset_id, purchase_date AS day FROM fuel_purchases"


@query("asof_odometer_forward", f"SELECT p.asset_id, day, min_by(odometer_km, record_date) AS odo_forward FROM ({_POINTS}) p LEFT JOIN telematics t ON t.asset_id = p.asset_id AND t.odometer_km IS NOT NULL AND record_date BETWEEN day AND day + 3 GROUP BY ALL", "odo_forward")
def _(f: Fleet):
    return I.asof_odometers(f.sql(_POINTS), f.telematics).drop("odo_backward")


@query("asof_odometer_backward", f"SELECT p.asset_id, day, max_by(odometer_km, record_date) AS odo_backward FROM ({_POINTS}) p LEFT JOIN telematics t ON t.asset_id = p.asset_id AND t.odometer_km IS NOT NULL AND record_date BETWEEN day - 3 AND day GROUP BY ALL", "odo_backward")
def _(f: Fleet):
    return I.asof_odometers(f.sql(_POINTS), f.telematics).drop("odo_forward")


@query("interval_days_join", f"WITH {_IV}, {_DAYS} SELECT * FROM dj", "odometer_km idle_hours")
def _(f: Fleet):
    return I.interval_days(I.build_intervals(f.fuel_purchases), f.telematics).withColumn("has_row", F.coalesce("has_row", F.lit(False)))


@query("missing_weekday_runs", f"WITH {_IV}, {_DAYS}, {_RUNS} SELECT asset_id, seq, cast(max_missing_run AS bigint) AS max_missing_run FROM mr")
def _(f: Fleet):
    return I.missing_weekday_runs(f.fuel_purchases, f.telematics, f.holidays)


@query("missing_odometer_runs", f"WITH {_IV}, {_DAYS}, {_RUNS} SELECT asset_id, seq, cast(max_odometer_run AS bigint) AS max_odometer_run FROM orun")
def _(f: Fleet):
    return I.missing_odometer_runs(f.fuel_purchases, f.telematics, f.holidays)


@query("evaluate_intervals", f"WITH {_EV} SELECT * FROM ev", "distance_km litres idle_hours")
def _(f: Fleet):
    return _evaluated(f)


@query("merge_orphaned_litres", MERGED + "SELECT * FROM merged", "distance_km litres idle_hours")
def _(f: Fleet):
    return merged(f)


_AUDIT = "SELECT asset_id, start_date AS interval_start_date, end_date AS interval_end_date, distance_km, litres, idle_hours, included, exclusion_reason FROM merged QUALIFY row_number() OVER (PARTITION BY asset_id, start_date, end_date ORDER BY seq) = 1"


@query("audit_dedup", MERGED + _AUDIT, "distance_km litres idle_hours")
def _(f: Fleet):
    return I.audit_rows(merged(f))


_OLD_AUDIT = "SELECT asset_id, record_date AS interval_start_date, record_date + 2 AS interval_end_date, 1e0 AS distance_km, 2e0 AS litres, 3e0 AS idle_hours, false AS included, 'old' AS exclusion_reason FROM telematics WHERE day(record_date) % 4 = 0"


@query("calibration_audit", f"WITH {_MERGED}, fresh AS ({_AUDIT}), old AS ({_OLD_AUDIT}) SELECT * FROM fresh UNION ALL SELECT old.* FROM old ANTI JOIN fresh USING (asset_id, interval_start_date, interval_end_date)", "distance_km litres idle_hours")
def _(f: Fleet):
    return I.upsert_audit(f.sql(_OLD_AUDIT), merged(f))


@query("regress_origin", MERGED + "SELECT asset_id, greatest(b, 0e0) AS slope, b AS raw_slope, CASE WHEN syy > 0 THEN 1 - greatest(syy - 2 * greatest(b, 0e0) * sxy + greatest(b, 0e0) * greatest(b, 0e0) * sxx, 0e0) / syy END AS r2, n FROM (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0e0 END AS b FROM (SELECT asset_id, sum(distance_km * litres) AS sxy, sum(distance_km * distance_km) AS sxx, sum(litres * litres) AS syy, count(*) AS n FROM merged WHERE included GROUP BY asset_id) x) y", "slope raw_slope r2")
def _(f: Fleet):
    return K.regress_origin(merged(f).filter("included"), ["asset_id"])


@query("calibrate_assets", f"WITH {_CAL} SELECT * FROM cal", "travel_rate_lpk raw_rate r2 idle_rate_lph")
def _(f: Fleet):
    return K.calibrate_assets(merged(f), f.assets)


@query("idle_anomaly", f"WITH {_CAL} SELECT asset_id, idle_rate_lph, anomalous FROM odd", "idle_rate_lph")
def _(f: Fleet):
    return K.idle_anomaly(K.calibrate_assets(merged(f), f.assets), f.assets).select("asset_id", "idle_rate_lph", "anomalous")


@query("apply_calibration", f"""WITH {_CAL} SELECT a.asset_id, CASE WHEN o.calibrated THEN o.travel_rate_lpk ELSE a.travel_rate_lpk END AS travel_rate_lpk, CASE WHEN o.calibrated THEN o.r2 END AS travel_rate_r2, CASE WHEN o.calibrated THEN o.included_count END AS calibration_interval_count,
    CASE WHEN o.calibrated AND NOT anomalous THEN o.idle_rate_lph ELSE a.idle_burn_rate_lph END AS idle_burn_rate_lph, coalesce(o.calibrated, false) AS calibrated_now, coalesce(o.calibrated AND anomalous, false) AS flagged_now FROM assets a LEFT JOIN odd o USING (asset_id)""", "travel_rate_lpk travel_rate_r2 idle_burn_rate_lph")  # fmt: skip
def _(f: Fleet):
    assets = f.assets.selectExpr("*", "cast(null as timestamp) as idle_anomaly_flagged_at", "cast(null as int) as calibration_interval_count", "cast(null as timestamp) as last_calibrated_at")
    r = K.idle_anomaly(K.calibrate_assets(merged(f), f.assets), f.assets)
    out = K.apply_calibration(assets, r, F.current_timestamp())
    return out.select("asset_id", "travel_rate_lpk", "travel_rate_r2", "calibration_interval_count", "idle_burn_rate_lph", F.col("last_calibrated_at").isNotNull().alias("calibrated_now"), F.col("idle_anomaly_flagged_at").isNotNull().alias("flagged_now"))


@query("loo_error", f"WITH {_POOL}, r AS ({_LOO.format(y='litres', fixed='0e0', rows='el')}) SELECT asset_id, loo AS loo_error_pct FROM r", "loo_error_pct")
def _(f: Fleet):
    return K.loo_median(K.eligible_intervals(merged(f), f.assets), ["asset_id"])


@query("centered_r2", f"WITH {_POOL} SELECT asset_id, CASE WHEN count(*) * var_pop(litres) > 0 THEN 1 - sum((litres - distance_km * 0.3e0) ** 2) / (count(*) * var_pop(litres)) END AS r2_centered FROM el GROUP BY asset_id", "r2_centered")
def _(f: Fleet):
    return K.centered_r2(K.eligible_intervals(merged(f), f.assets).withColumn("p", F.col("distance_km") * 0.3), ["asset_id"], "p")


@query("pooled_fit", f"WITH {_POOL} SELECT t.user_id, asset_id, t.idle_class, travel_rate, class_rate FROM t{_LAST} t JOIN c{_LAST} c ON c.user_id = t.user_id AND c.idle_class = t.idle_class", "travel_rate class_rate")
def _(f: Fleet):
    travel, classes = K.pooled_fit(K.eligible_intervals(merged(f), f.assets))
    return travel.join(classes, ["user_id", "idle_class"])


_BOTH = f"""{_CAL}, {_POOL.split(_MERGED + ', ')[1]}, iv2 AS (SELECT e.*, t.travel_rate, c.class_rate, cal.travel_rate_lpk AS old_rate, cal.idle_rate_lph AS old_idle FROM el e JOIN t{_LAST} t USING (asset_id) JOIN c{_LAST} c ON c.user_id = e.user_id AND c.idle_class = e.idle_class JOIN cal USING (asset_id)),
  lo AS ({_LOO.format(y='litres', fixed='0e0', rows='iv2')}), ln AS ({_LOO.format(y='greatest(litres - class_rate * idle_hours, 0e0)', fixed='class_rate * idle_hours', rows='iv2')}),
  hd AS (SELECT user_id, asset_id, any_value(idle_class) AS idle_class, any_value(old_rate) AS old_travel_rate, any_value(old_idle) AS old_idle_rate, any_value(travel_rate) AS travel_rate, any_value(class_rate) AS class_rate,
    CASE WHEN count(*) * var_pop(litres) > 0 THEN 1 - sum((litres - old_rate * distance_km) ** 2) / (count(*) * var_pop(litres)) END AS old_r2, CASE WHEN count(*) * var_pop(litres) > 0 THEN 1 - sum((litres - travel_rate * distance_km - class_rate * idle_hours) ** 2) / (count(*) * var_pop(litres)) END AS new_r2 FROM iv2 GROUP BY user_id, asset_id)
"""


@query("compare_models", f"WITH {_BOTH} SELECT hd.*, lo.loo AS old_loo_pct, ln.loo AS new_loo_pct, median(lo.loo) OVER (PARTITION BY hd.user_id) AS account_old_loo_pct, median(ln.loo) OVER (PARTITION BY hd.user_id) AS account_new_loo_pct FROM hd JOIN lo USING (asset_id) JOIN ln USING (asset_id)", "old_travel_rate old_idle_rate travel_rate class_rate old_r2 new_r2 old_loo_pct new_loo_pct account_old_loo_pct account_new_loo_pct")
def _(f: Fleet):
    m = cut(merged(f))  # read by the fit, by both models and by both errors
    el = cut(K.eligible_intervals(m, f.assets))
    return K.compare_models(el, m, f.assets, K.pooled_fit(el))


@query("idle_class_rates", f"SELECT asset_id, {_CLASS} AS idle_class FROM assets")
def _(f: Fleet):
    return f.assets.select("asset_id", X.idle_class(F.col("asset_name")).alias("idle_class"))
