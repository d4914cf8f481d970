import datetime as dt
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from axleyard import tables
from axleyard.operators import calibrate as K
from axleyard.operators import intervals as I

D = lambda n: dt.date(2024, 3, 1) + dt.timedelta(n)  # noqa: E731  (2024-03-01 is a Friday)
TEL = "asset_id long, record_date date, odometer_km double, idle_hours double"


def evaluated(spark, fills, tel, holidays=()):
    p = spark.createDataFrame([(1, D(d), l, 1.0) for d, l in fills], "vehicle_id long, purchase_date date, litres double, cost_nzd double")
    t = spark.createDataFrame([(1, D(d), o, i) for d, o, i in tel], TEL)
    h = spark.createDataFrame([(D(d),) for d in holidays], "holiday_date date")
    return I.evaluate_intervals(p, t, h)


def reasons(spark, *a, **k):
    return [r.exclusion_reason for r in evaluated(spark, *a, **k).orderBy("seq").collect()]


FULL = [(d, 100.0 * d, 1.0) for d in range(30)]


def test_reasons(spark):
    without = lambda *days: [x for x in FULL if x[0] not in days]
    assert reasons(spark, [(0, 50.0), (10, 50.0)], FULL) == [None]
    assert reasons(spark, [(0, 50.0), (10, 2.0)], FULL) == ["implausible_litres"]
    assert reasons(spark, [(0, 50.0), (10, -1.0), (12, None)], FULL) == ["invalid_litres", "invalid_litres"]
    assert reasons(spark, [(0, 50.0), (0, 60.0)], FULL) == ["non_positive_distance"]
    assert reasons(spark, [(0, 50.0), (40, 60.0)], FULL) == ["missing_odometer_boundary"]
    assert reasons(spark, [(0, 50.0), (12, 60.0)], without(3, 5)) == ["telematics_gap"]  # Monday and Wednesday, a report between
    assert reasons(spark, [(0, 50.0), (12, 60.0)], without(0, 3)) == ["telematics_gap"]  # over a weekend
    assert reasons(spark, [(0, 50.0), (12, 60.0)], without(7, 10), holidays=[10]) == [None]  # Friday; the Monday is a holiday
    assert reasons(spark, [(0, 50.0), (12, 60.0)], without(7, 11), holidays=[10]) == [None]  # four days apart: no run
    blank = [(d, None if d in (4, 5) else o, i) for d, o, i in FULL]
    assert reasons(spark, [(0, 50.0), (12, 60.0)], blank) == ["odometer_gap"]


def test_nearest_odometers_and_idle(spark):
    tel = [(2, 200.0, 1.5), (9, 900.0, 2.0), (10, None, 4.0), (11, None, 8.0)]
    r = evaluated(spark, [(0, 50.0), (11, 60.0)], tel).first()
    assert (r.distance_km, r.idle_hours) == (700.0, 7.5)  # two days after the start, two before the end; the end day does not count


def test_merge_forward(spark):
    rows = [(1, 1, 5.0, "non_positive_distance"), (1, 2, 6.0, "non_positive_distance"), (1, 3, 7.0, None), (1, 4, None, "non_positive_distance"), (1, 5, 9.0, "telematics_gap"), (1, 6, 2.0, "non_positive_distance")]
    df = spark.createDataFrame(rows, "asset_id long, seq int, litres double, exclusion_reason string")
    got = I.merge_orphaned_litres(df).orderBy("seq").collect()
    m = "non_positive_distance_litres_merged_forward"
    assert [(r.litres, r.exclusion_reason) for r in got] == [(5.0, m), (11.0, m), (18.0, None), (None, m), (9.0, "telematics_gap"), (2.0, "non_positive_distance")]


def test_merge_keeps_litres(spark):
    rng = random.Random(2)
    rows = [(a, s, float(rng.randrange(1, 50)), rng.choice([None, "non_positive_distance", "telematics_gap"])) for a in range(20) for s in range(rng.randrange(1, 25))]
    got = I.merge_orphaned_litres(spark.createDataFrame(rows, "asset_id int, seq int, litres double, exclusion_reason string")).collect()
    kept = sum(r.litres for r in got if not (r.exclusion_reason or "").endswith("forward"))
    assert kept == sum(r[2] for r in rows)


@pytest.mark.parametrize("points, slope, raw, r2", [
    ([(x, 0.35 * x) for x in range(100, 1001, 100)], 0.35, 0.35, 1.0), ([(x, 0.35 * x) for x in range(100, 1001, 100)] + [(10, 500)], 1352500 / 3850100, 1352500 / 3850100, None),
    ([(100, -50), (200, -100), (50, -25)], 0.0, -0.5, 0.0), ([(x, 0.35 * x) for x in range(100, 601, 100)] + [(x, 0.28 * x) for x in range(700, 1201, 100)], 188.37 / 650, 188.37 / 650, None),
])
def test_regression(spark, points, slope, raw, r2):
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in points], "a int, distance_km double, litres double")
    r = K.regress_origin(df, ["a"]).first()
    assert abs(r.slope - slope) < 1e-9 and abs(r.raw_slope - raw) < 1e-9 and (r2 is None or abs(r.r2 - r2) < 1e-9)


def test_regression_with_noise(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(1, float(x), x * (0.35 + rng.uniform(-0.01, 0.01))) for x in range(100, 2001, 100)], "a int, distance_km double, litres double")
    r = K.regress_origin(df, ["a"]).first()
    assert abs(r.slope - 0.35) < 0.0175 and r.r2 > 0.9


def test_calibration(spark):
    inc = lambda a, n: [(a, i, 100.0, 40.0, 2.0, True) for i in range(n)]
    df = spark.createDataFrame(inc(1, 6) + inc(2, 5) + inc(3, 6), "asset_id long, seq int, distance_km double, litres double, idle_hours double, included boolean")
    assets = spark.createDataFrame([(1, None, 1.0, False), (2, 0.2, None, False), (3, 0.2, 1.0, False)], "asset_id long, travel_rate_lpk double, idle_burn_rate_lph double, idle_anomaly_confirmed boolean")
    got = {r.asset_id: r for r in K.idle_anomaly(K.calibrate_assets(df, assets), assets).collect()}
    assert (got[1].calibrated, got[1].travel_rate_lpk, got[1].idle_rate_lph, got[1].was_capped) == (True, 0.4, 0.0, False)
    assert (got[2].calibrated, got[2].reason, got[2].travel_rate_lpk) == (False, "insufficient_intervals", None)
    assert got[3].was_capped and abs(got[3].travel_rate_lpk - 0.26) < 1e-12 and abs(got[3].idle_rate_lph - 7.0) < 1e-9 and got[3].anomalous


def test_leave_one_out(spark):
    rng = random.Random(3)
    rows = [(a, float(rng.randrange(50, 500)), float(rng.randrange(20, 200)), float(rng.randrange(0, 9))) for a in range(4) for _ in range(a * 2 + 2)]
    df = spark.createDataFrame(rows, "a int, distance_km double, litres double, idle_hours double").withColumn("rate", F.lit(2.0))
    for rate in (None, "rate"):
        got = {r.a: r.loo_error_pct for r in K.loo_median(df, ["a"], rate).collect()}
        for a in range(4):
            own, errors = [r for r in rows if r[0] == a], []
            for i, held in enumerate(own):
                train = own[:i] + own[i + 1 :]
                y = lambda r: max(0.0, r[2] - 2.0 * r[3]) if rate else r[2]
                if len(train) >= 2:
                    s = max(0.0, sum(r[1] * y(r) for r in train) / sum(r[1] ** 2 for r in train))
                    errors.append(abs(s * held[1] + (2.0 * held[3] if rate else 0) - held[2]) / held[2] * 100)
            errors.sort()
            want = None if not errors else errors[len(errors) // 2] if len(errors) % 2 else (errors[len(errors) // 2 - 1] + errors[len(errors) // 2]) / 2
            assert got[a] == want if want is None else abs(got[a] - want) < 1e-9


def test_working_days_without_a_table_of_holidays(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2026-04-01', DATE'2026-04-07')) AS record_date")
    on = lambda w: [str(r.record_date) for r in days.filter(w.on(F.unix_date("record_date"))).orderBy("record_date").collect()]
    assert on(I.WorkingDays()) == ["2026-04-01", "2026-04-02", "2026-04-07"]
    none = spark.sql("SELECT DATE'2000-01-01' AS holiday_date").limit(0)
    assert len(on(I.WorkingDays(none))) == 5


def longest(days):
    """By walking: of sorted day numbers, the longest run of those at most three apart."""
    best = run = 0
    last = None
    for d in days:
        run = run + 1 if last is not None and d - last <= 3 else 1
        best, last = max(best, run), d
    return best or None


def test_facts_of_intervals_equal_walking_day_by_day(spark):
    rng = random.Random(11)
    fills, tel, holidays = [], [], sorted({D(rng.randrange(-5, 400)) for _ in range(40)} | {D(d) for d in range(100, 112)})
    for a in range(25):
        fills += [(a, D(rng.randrange(0, 380)), float(rng.randrange(1, 60)), 1.0) for _ in range(rng.randrange(1, 9))]
        dense = rng.random()
        tel += [(a, D(d), rng.choice([None, 10.0 * d]), rng.choice([None, 0.5, 2.0])) for d in range(-10, 400) if rng.random() < dense]
    p = spark.createDataFrame(fills, "vehicle_id long, purchase_date date, litres double, cost_nzd double")
    got = {(r.asset_id, r.seq): r for r in I.interval_facts(p, spark.createDataFrame(tel, TEL), spark.createDataFrame([(h,) for h in holidays], "holiday_date date")).collect()}
    at, n = {(a, d): (o, i) for a, d, o, i in tel}, 0
    for a in range(25):
        own = sorted(f[1:3] for f in fills if f[0] == a)
        for k in range(1, len(own)):
            n += 1
            start, end, r = own[k - 1][0], own[k][0], got[a, k + 1]
            days = [start + dt.timedelta(x) for x in range((end - start).days)]
            work = [d for d in days if d.weekday() < 5 and d not in holidays]
            number = lambda d: d.toordinal()
            assert (r.start_date, r.end_date, r.litres) == (start, end, own[k][1])
            assert r.max_missing_run == longest([number(d) for d in work if (a, d) not in at]), (a, k, start, end)
            assert r.max_odometer_run == longest([number(d) for d in work if (a, d) in at and at[a, d][0] is None])
            assert abs(r.idle_hours - sum(at[a, d][1] or 0.0 for d in days if (a, d) in at)) < 1e-9
            near = [at.get((a, start + dt.timedelta(x)), (None, None))[0] for x in range(4)]
            assert r.start_odo == next((o for o in near if o is not None), None)
            near = [at.get((a, end - dt.timedelta(x)), (None, None))[0] for x in range(4)]
            assert r.end_odo == next((o for o in near if o is not None), None)
    assert n == len(got) > 60


def test_litres_left_over_by_binary_search(spark):
    rng = random.Random(4)
    rows = [(1, a, "c", float(rng.randrange(0, 50)), rng.choice([0.0, -3.0, rng.random() * 40]), rng.choice([0.0, rng.random() * 9])) for a in range(30) for _ in range(rng.randrange(1, 40))]
    terms = K.asset_terms(spark.createDataFrame(rows, "user_id int, asset_id int, idle_class string, distance_km double, litres double, idle_hours double"))
    for rate in (0.0, 0.7, 3.3, 50.0):
        for r in terms.select("asset_id", K.left_over(F.lit(rate)).alias("got")).collect():
            assert abs(r.got - sum(x * max(0.0, y - rate * i) for _, a, _, x, y, i in rows if a == r.asset_id)) < 1e-9


def test_rounds_do_not_shuffle_intervals(spark):
    rows = spark.createDataFrame([(1, 1, "standard_truck", 5.0, 2.0, 1.0)], "user_id int, asset_id int, idle_class string, distance_km double, litres double, idle_hours double")
    text = K.pooled_fit(rows)[0]._jdf.queryExecution().executedPlan().toString()
    assert "distance_km" not in text


def test_no_machine_local_folder_on_a_cluster():
    def on(master):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            tables.local_folder(on(master))
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(tables.local_folder(on(master)))


def test_recalibration_by_batch_equals_a_full_run(spark, tmp_path):
    from axleyard.streaming import calibration as C

    rng = random.Random(8)
    fills = [(a, D(d), float(rng.randrange(20, 60)), 1.0) for a in range(12) for d in range(0, 160, 9 + a % 4)]
    tel = [(a, D(d), 50.0 * d + a, 1.0) for a in range(12) for d in range(170)]
    assets = spark.createDataFrame([(a, 0.3 if a % 2 else None) for a in range(12)], "asset_id long, travel_rate_lpk double")
    none = spark.createDataFrame([], "holiday_date date")
    F_, T_ = "vehicle_id long, purchase_date date, litres double, cost_nzd double", TEL
    store = C.calibration_store(spark, f"file://{tmp_path}/c")
    late = lambda r: r[0] in (3, 7) and r[1] > D(80)
    now_f, now_t = [f for f in fills if not late(f)], [t for t in tel if not late(t)]
    ids = lambda x: spark.createDataFrame([(a,) for a in x], "asset_id long")
    C.recalibrate(store, 0, ids(range(12)), spark.createDataFrame(now_f, F_), spark.createDataFrame(now_t, T_), assets, none)
    first = store.manifest()
    # late rows of two assets, one of them in the middle of what there was
    fills.append((7, D(40), 33.0, 1.0))
    p, t = spark.createDataFrame(fills, F_), spark.createDataFrame(tel, T_)
    C.recalibrate(store, 1, ids([3, 7]), p, t, assets, none)
    m = store.manifest()
    moved = {part for part, x in m["tables"]["rates"].items() if x["v"] == 1}
    assert m["assets"] == 2 and moved == set(m["parts"]) and len(moved) <= 2 and first["tables"]["rates"].keys() == m["tables"]["rates"].keys()
    merged = I.merge_orphaned_litres(I.evaluate_intervals(p, t, none))
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert rows(store.read("rates", m)) == rows(K.calibrate_assets(merged, assets))
    named = merged.withColumnsRenamed({"start_date": "interval_start_date", "end_date": "interval_end_date"})
    assert rows(store.read("intervals", m)) == rows(named)
    # the audit keeps the interval that the late fill split
    kept = {(r.asset_id, r.interval_start_date, r.interval_end_date) for r in store.read("audit", m).collect()}
    now = {(r.asset_id, r.start_date, r.end_date) for r in merged.collect()}
    gone = kept - now
    assert now <= kept and [a for a, s, e in gone] == [7] and all(s < D(40) < e for _, s, e in gone)
    before = store.manifest()
    C.recalibrate(store, 1, ids(range(12)), p.limit(0), t, assets, none)
    assert store.manifest() == before
