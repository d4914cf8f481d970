import datetime as dt
import random

from pyspark.sql import functions as F

from axleyard import schemas as S
from axleyard.operators import costs, resolve, scan, telematics, upsert, utilisation
from axleyard.plans.fixtures import Fleet

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
ASSET = "asset_id long, is_on_road boolean, asset_type string, current_odometer double, current_value double, estimated_end_of_life_value double, expected_life_km double, expected_life_hours double, estimated_annual_repair_cost double, estimated_annual_km double, available_hours_per_week double, target_utilisation_percent double, service_cost_per_km double, service_cost_per_hour double"


def rates(spark, hours=1000.0, **kw):
    base = {"asset_id": 1, "is_on_road": False, "asset_type": "Crane", "current_odometer": 1000.0, "current_value": 9000.0, "estimated_end_of_life_value": 1000.0, "expected_life_km": 5000.0, "expected_life_hours": 5000.0, "estimated_annual_repair_cost": 520.0, "estimated_annual_km": 1000.0, "available_hours_per_week": 40.0, "target_utilisation_percent": 50.0, "service_cost_per_km": 0.1, "service_cost_per_hour": 2.0}
    row = base | kw
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in ASSET.split(", "))], ASSET).withColumn("total_engine_hours", F.lit(hours).cast("double"))
    return costs.with_rates(df).first()


def test_depreciation(spark):
    assert rates(spark).dep_hour.value == 2.0 and rates(spark, is_on_road=True).dep_km.value == 2.0
    assert rates(spark, estimated_end_of_life_value=20000.0).dep_hour.value == 0.0
    r = rates(spark, hours=5000.0).dep_hour
    assert (r.ok, r.value, r.life_exceeded, r.life_near_limit) == (False, None, True, False)
    r = rates(spark, hours=4900.0).dep_hour  # within 2 % of 5000
    assert (r.ok, r.life_exceeded, r.life_near_limit) == (False, True, True)
    assert rates(spark, hours=4899.0).dep_hour.ok
    assert rates(spark, hours=None).dep_hour.missing == ["Total Engine Hours"]
    assert rates(spark, is_on_road=True, current_value=None, expected_life_km=None).dep_km.missing == ["Current Value", "Expected Total Life (km)"]


def test_maintenance_and_servicing(spark):
    assert rates(spark).maint_hour.value == 0.5 and rates(spark).serv.value == 2.0
    assert "annual usage" in rates(spark, target_utilisation_percent=0.0).maint_hour.missing[0]
    road = rates(spark, is_on_road=None, asset_type=" Rigid Truck ")
    assert road.on_road and road.maint_km.value == 0.52 and road.serv.value == 0.1
    assert rates(spark, is_on_road=True, estimated_annual_km=0.0).maint_km.missing == ["Estimated Annual KM"]


def test_upsert_telematics_writes_only_its_columns(spark):
    old = spark.createDataFrame([(1, 5, D(0), 1.0, 2.0, 3.0, 4.0, 5.0)], S.TELEMATICS)
    new = spark.createDataFrame([(1, 5, D(0), 9.0, None, 1), (1, 5, D(0), 8.0, None, 2), (1, 6, D(0), 7.0, None, 1)], "user_id long, asset_id long, record_date date, odometer_km double, litres_consumed double, pos int")
    once = upsert.upsert_telematics(old, new, ["odometer_km", "litres_consumed"])
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, 5, D(0), 1.0, 2.0, 3.0, 8.0, None), (1, 6, D(0), None, None, None, 7.0, None)]
    assert sorted(map(tuple, upsert.upsert_telematics(once, new, ["odometer_km", "litres_consumed"]).collect())) == rows  # again: the same


def test_price_band_and_order_of_reasons(spark):
    cols = "import_id int, user_id int, asset_id int, card string, purchase_date date, litres double, cost double, product string, odometer double, pos int"
    rows = [(1, 1, 7, "C", D(0), 10.0, c, p, 0.0, i) for i, (c, p) in enumerate([(4.9, "NZ Diesel"), (5.0, "NZ Diesel"), (60.0, "NZ Ultimate"), (60.1, "NZ Diesel"), (None, "NZ AdBlue"), (20.0, "NZ AdBlue"), (5.0, "NZ Diesel")])]
    rows += [(1, 1, None, "C", D(0), 10.0, 20.0, "NZ Diesel", 5.0, 10), (1, 1, 7, "", D(0), 10.0, 20.0, "NZ Diesel", 5.0, 11), (1, 1, 7, "C", D(0), 0.0, 20.0, "NZ Diesel", 5.0, 12)]
    got = {r.pos: r.reject_reason for r in resolve.clean_bp_transaction(spark.createDataFrame(rows, cols)).collect()}
    assert got == {0: "price_out_of_band", 1: None, 2: "duplicate", 3: "price_out_of_band", 4: "no_cost", 5: "not_fuel", 6: "duplicate", 10: "no_asset", 11: "bad_key", 12: "bad_key"}
    lenient = {r.pos: r.reject_reason for r in resolve.clean_bp(spark.createDataFrame(rows, cols)).collect()}
    assert lenient[12] is None and lenient[6] is None and lenient[11] == "no_card" and lenient[4] == "not_fuel"


def test_running_odometer_in_file_order(spark):
    m = spark.createDataFrame([(1, 1, 5, D(1), 10.0, 3, 1), (1, 1, 5, D(0), 5.0, 9, 1), (2, 1, 5, D(2), 1.0, 1, 2), (1, 1, 6, D(0), 2.0, 1, 1)], "import_id int, user_id int, asset_id int, record_date date, distance double, first_pos int, received_at int")
    tel = spark.createDataFrame([(5, D(-3), 100.0), (5, D(-2), 0.0)], "asset_id int, record_date date, odometer_km double")
    assets = spark.createDataFrame([(5, 70.0), (6, None)], "asset_id int, current_odometer double")
    got = {(r.asset_id, r.record_date): r.odometer_km for r in telematics.running_odometer(m, tel, assets).collect()}
    assert got == {(5, D(1)): 110.0, (5, D(0)): 115.0, (5, D(2)): 116.0, (6, D(0)): 2.0}
    rows = lambda n: sorted(map(tuple, telematics.running_odometer(m, tel, assets, n).collect()))
    assert rows(1) == rows(None)


def test_running_sums_spread_over_tasks(spark):
    rng = random.Random(1)
    rows = [(1 if k % 3 else k % 17 + 2, k % 5, rng.randrange(10**6), float(rng.randrange(100))) for k in range(3000)]
    df = spark.createDataFrame(rows, "asset_id int, a int, b int, km double").dropDuplicates(["asset_id", "a", "b"])
    own = scan.running_sum(df, "asset_id", ["a", "b"], "km", "run", range_rows=100)
    want, run = {}, {}
    for r in sorted(df.collect()):
        want[r.asset_id, r.a, r.b] = run[r.asset_id] = run.get(r.asset_id, 0.0) + r.km
    assert {(r.asset_id, r.a, r.b): r.run for r in own.collect()} == want
    # two thirds of the rows are one asset's, yet no window holds more than a range
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and own.columns == [*df.columns, "run"]
    assert scan.running_sum(df.limit(0), "asset_id", ["a", "b"], "km", "run").count() == 0


def test_utilisation_statuses(spark):
    row = lambda has, av, act, target: spark.range(1).select(utilisation.utilisation_status((F.lit(act) / F.nullif(F.lit(av), F.lit(0.0)) * 100).cast("double"), F.lit(target).cast("double"), F.lit(has), F.lit(av), F.lit(act)).alias("s")).first().s
    assert [row(False, 8.0, 0.0, 50.0), row(True, 0.0, 2.0, 50.0), row(True, 8.0, 4.0, None), row(True, 8.0, 9.0, 50.0), row(True, 8.0, 4.0, 50.0), row(True, 8.0, 1.0, 50.0), row(True, 0.0, 0.0, 50.0)] == ["no-data", "exceeds-capacity", "no-target", "exceeds-capacity", "on-target", "below-target", "below-target"]


def test_split_sums_to_litres(spark):
    f = Fleet(spark, "/root/testdata/sf0.001")
    from axleyard.operators.emissions import emissions_daily

    bad = emissions_daily(f.assets, f.fuel_records, f.telematics).filter("abs(operating_litres + idle_litres - litres) > 1e-9 or idle_litres > litres")
    assert bad.count() == 0


def test_upserts_without_shuffling_the_target(spark):
    old = spark.createDataFrame([(1, a, D(d), 1.0, 2.0, 3.0, 4.0, 5.0) for a in range(5) for d in range(4)], S.TELEMATICS)
    new = spark.createDataFrame([(1, 2, D(1), 9.0, 1), (1, 9, D(1), 8.0, 1)], "user_id long, asset_id long, record_date date, odometer_km double, pos int")
    few, many = (upsert.upsert_telematics(old, new, ["odometer_km"], small_rows=n) for n in (10, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == 21
    fuel = spark.createDataFrame([(1, v, D(0), 10.0, 20.0, None, "x") for v in range(6)], S.FUEL_PURCHASES)
    again = fuel.filter("vehicle_id < 3").withColumn("cost_nzd", F.lit(7.0)).withColumn("batch_seq", F.lit(1))
    few, many = (upsert.upsert_fuel(fuel, again, small_rows=n) for n in (10, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.filter("cost_nzd = 7").count() == 3
