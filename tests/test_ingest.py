"""Files of all formats: taken in at once, one by one, and as a stream."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from axleyard import schemas as S
from axleyard.operators import resolve
from axleyard.operators.ingest import ingest_files
from axleyard.operators.odometers import odometers_in_order
from axleyard.session import SETTINGS
from axleyard.streaming import jobs

TX = "Transaction Effective Date,Card Number,Litres,Customer Value ($),Product,Vehicle Description,Driver Name\n"
BP = "Transaction Effective Date,Card Number,Litres,Customer Value ($),Product,Driver Name\n"
MOBIL = "Transaction Date,Card No.,Description,Quantity,Total,GST,Product Description,Odometer\n"
MILES = "Vehicle,ActivityDate,ActualDistance\n"
IDLE = "Vehicle,IdleStart,IdleEnd,Duration,Unit\n"
EXEC = "VehicleName,TotalHours,IdleTime,AverageDailyIgnitionTime\n"
#: In the order in which they come. A plain card and a name are unseen until a later file makes an asset of them.
FILES = [
    ("a_plain.csv", BP + "1/3/2024,C9,10,$20,NZ Diesel,T9\n2/3/2024,C5,11,$22,NZ Diesel,\n"),
    ("b_miles.csv", MILES + "V5,01/03/2024,10\nV5,02/03/2024,5\nT9,02/03/2024,4\nstranger,01/03/2024,3\n"),
    ("c_tx.csv", TX + "1/3/2024,C5,50,100,NZ Diesel,V5,\n1/3/2024,C5,50,100,NZ Diesel,V5,\n3/3/2024,C9,40,80,NZ Diesel,T9,\n3/3/2024,C9,40,800,NZ Diesel,T9,\n"),
    ("d_miles.csv", MILES + "T9,03/03/2024,6\nV5,02/03/2024,1\nV5,01/04/2024,2\nhidden,01/04/2024,2\n"),
    ("summary_2024-03-02.csv", EXEC + "V5,600,60,7\nV6,300,,8\nT9,120,30,0\n"),
    ("e_tx.csv", TX + "1/3/2024,C5,50,120,NZ Diesel,V5,\n"),
    ("f_mobil.csv", MOBIL + "04/03/2024,M1,T77,30,66,6,Diesel,5\n05/03/2024,M1,T77,30,66,6,Shop,5\n04/04/2024,M6,,20,44,4,Unleaded 91,\n"),
    ("g_idle.csv", IDLE + "V5,02/03/2024 09:00,02/03/2024 09:30,30,min\nV5,02/03/2024 10:00,02/03/2024 10:45,45,\nT77,02/03/2024 10:00,02/03/2024 11:00,60,min\nnewcomer,02/03/2024 10:00,,5,min\n"),
    ("h_plain.csv", BP + "6/3/2024,C9,10,$20,NZ Diesel,T9\n6/3/2024,C7,10,$20,NZ Diesel,Zed 1\n6/3/2024,C8,10,$21,NZ Diesel,Zed 1\n"),
    ("i_unknown.csv", "Litres and fuel,card number\n1,2\n"),
    ("summary_2024-03-01.csv", EXEC + "V5,100,10,3\nnewcomer,100,10,3\n"),
    ("j_miles.csv", MILES + "V5,03/03/2024,100\nV6,05/03/2024,1\nV6,04/03/2024,2\n"),
    ("summary_2024-04-01.csv", EXEC + "V5,100,10,0\n"),
    ("k_miles.csv", MILES + "V5,02/04/2024,9\n"),
]
ASSETS = [(5, 1, "V5", "Rigid Truck", "Diesel", "C5", None, 100.0), (6, 1, "V6", None, None, None, "M6", None)]
FILE = "import_id string, user_id long, filename string, received_at timestamp, raw_csv string"


@pytest.fixture(scope="module")
def world(spark):
    for k, v in SETTINGS.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    files = [(name, 1, name, dt.datetime(2024, 5, 1, 0, k), raw) for k, (name, raw) in enumerate(FILES)]
    old = spark.createDataFrame([(1, 5, dt.date(2024, 2, 28), 1.0, 1.0, None, 200.0, 3.0), (1, 5, dt.date(2024, 3, 2), None, None, 9.0, 210.0, 3.0)], S.TELEMATICS)
    return files, spark.createDataFrame(ASSETS, S.ASSETS), spark.createDataFrame([(1, " hidden ")], "user_id long, asset_name string"), old


def rows(df, *drop):
    return sorted(map(str, df.select(*sorted(c for c in df.columns if c not in drop)).collect()))


def outcome(i):
    return {n: rows(getattr(i, n)) for n in ("telematics", "fuel", "assets", "pending", "status", "rejects")}


@pytest.fixture(scope="module")
def at_once(spark, world):
    files, assets, ignored, old = world
    return outcome(ingest_files(spark.createDataFrame(files, FILE), assets, ignored, old, spark.createDataFrame([], S.FUEL_PURCHASES), S.MAIL_ORDER))


def test_in_parts_equals_at_once(spark, world, at_once):
    files, assets, ignored, tel = world
    fuel, pending, done = spark.createDataFrame([], S.FUEL_PURCHASES), None, {"status": [], "rejects": []}
    for a, b in ((0, 1), (1, 4), (4, 6), (6, len(files))):
        i = ingest_files(spark.createDataFrame(files[a:b], FILE), assets, ignored, tel, fuel, S.MAIL_ORDER, pending)
        assets, tel, fuel, pending = (spark.createDataFrame(df.collect(), df.schema) for df in (i.assets, i.telematics, i.fuel, i.pending))
        for n in done:
            done[n] += rows(getattr(i, n))
    assert {"telematics": rows(tel), "fuel": rows(fuel), "assets": rows(assets), "pending": rows(pending), **{n: sorted(x) for n, x in done.items()}} == at_once


def test_what_at_once_gives(spark, world, at_once):
    status = {s.split("import_id='")[1].split("'")[0]: s for s in at_once["status"]}
    assert all("status='processed'" in status[n] for n in ("c_tx.csv", "e_tx.csv", "h_plain.csv", "j_miles.csv"))
    assert "detected_category='fuel_provider'" in status["i_unknown.csv"] and "detected_headers='Litres and fuel,card number'" in status["i_unknown.csv"]
    assert "pending_added=1" in status["a_plain.csv"] and "pending_added=2" in status["h_plain.csv"] and "pending_added=2" in status["b_miles.csv"]
    assert any("cost_nzd=120.0" in x and "litres=50.0" in x for x in at_once["fuel"]) and not any("cost_nzd=100.0" in x for x in at_once["fuel"])
    names = [x.split("asset_name='")[1].split("'")[0] for x in at_once["pending"]]
    assert sorted(names) == ["T9", "Zed 1", "newcomer", "stranger"]
    by = {(int(x.split("asset_id=")[1].split(",")[0]), x.split("record_date=")[1].split(")")[0]): x.split("odometer_km=")[1].split(",")[0] for x in at_once["telematics"]}
    at = lambda m, d: by[5, f"datetime.date(2024, {m}, {d}"]
    # b: 210 + 10 and + 5 more; d from 225: 1 more, 2 more; the summary adds 7 to the 228 of April
    assert (at(3, 1), at(3, 2), at(4, 1), at(3, 3), at(4, 2)) == ("231.0", "235.0", "None", "328.0", "337.0")


def test_stream_in_any_batching_equals_at_once(spark, world, at_once, tmp_path):
    files, assets, ignored, old = world
    for size in (5,):
        place, store_path = tmp_path / f"in{size}", f"file://{tmp_path}/store{size}"
        place.mkdir()
        for k, (name, raw) in enumerate(FILES):
            (place / name).write_text(raw)
            when = dt.datetime(2024, 5, 1, 0, k, tzinfo=dt.timezone.utc).timestamp()
            os.utime(place / name, (when, when))
        store = jobs.fleet_store(spark, store_path, assets, old)
        account = lambda df: df.withColumn("user_id", F.lit(1).cast("long"))
        run = lambda: jobs.stream_ingest(jobs.read_file_stream(spark, f"file://{place}", size), store, account, f"file://{tmp_path}/state{size}", ignored).awaitTermination()
        # the stream's order of formats is the mail's or the upload's alike for these files
        run()
        m = store.manifest()
        got = {n: rows(store.read(n, m)) for n in ("telematics", "fuel", "assets", "pending", "status", "rejects")}
        assert got == at_once, size
        assert len(store.versions()) == 2
        run()
        assert store.manifest() == m


def test_a_batch_touches_its_months_alone(spark, world, tmp_path):
    _, assets, ignored, _ = world
    day = lambda m, d: dt.date(2024, m, d)
    old = spark.createDataFrame([(1, 5, day(m, d), 1.0, None, None, 100.0 * m + d, None) for m in range(1, 7) for d in range(1, 28)], S.TELEMATICS)
    store = jobs.fleet_store(spark, f"file://{tmp_path}/t", assets, old)
    first = store.manifest()["tables"]["telematics"]
    # months that a batch does not touch may not even be there
    for part in ("2024-01", "2024-02", "2024-04", "2024-05"):
        shutil.rmtree(tmp_path / f"t/telematics/v=0/part={part}")
    batch = lambda raw, v: jobs.take_batch(spark.createDataFrame([(f"f{v}", 1, "x.csv", dt.datetime(2024, 7, 1), raw)], FILE), store, v, ignored)
    batch(MILES + "V5,03/03/2024,10\nV5,30/06/2024,5\n", 1)
    m = store.manifest()
    assert m["months"] == {"telematics": ["2024-03", "2024-06"], "fuel": []} and m["read_bytes"]["telematics"] == sum(sum(first[p]["files"].values()) for p in ("2024-03", "2024-06"))
    assert {p: x["v"] for p, x in m["tables"]["telematics"].items()} == {"2024-01": 0, "2024-02": 0, "2024-03": 1, "2024-04": 0, "2024-05": 0, "2024-06": 1}
    got = {r.record_date: r.odometer_km for r in store.read("telematics", m, {"2024-03", "2024-06"}).collect()}
    assert got[day(3, 3)] == 637.0 and got[day(6, 30)] == 642.0 and len(got) == 55
    assert m["tables"]["telematics"]["2024-06"] | {"files": 0} == {"v": 1, "files": 0, "rows": 28, "min": "5", "max": "5"}
    # a batch that failed before its commit left files: they are replaced; one that was committed is not run again
    (tmp_path / "t/telematics/v=2/part=2024-03").mkdir(parents=True)
    (tmp_path / "t/telematics/v=2/part=2024-03/part-x.parquet").write_text("half")
    batch(TX + "1/7/2024,C1,40,80,NZ Diesel,V5,\n", 2)
    batch(MILES + "V5,03/03/2024,999\n", 2)
    assert store.read("fuel", store.manifest()).count() == 1 and store.read("telematics", store.manifest(), {"2024-03"}).filter("odometer_km > 1000").count() == 0
    # the asset made of a card keeps its id in a retry
    made = store.read("assets", store.manifest()).filter("bp_card_number = 'C1'").first().asset_id
    (tmp_path / "t/_manifests/000000000002.json").unlink()
    batch(TX + "1/7/2024,C1,40,80,NZ Diesel,V5,\n", 2)
    assert store.read("assets", store.manifest()).filter("bp_card_number = 'C1'").first().asset_id == made
    batch(MILES + "V5,04/03/2024,1\n", 3)
    assert store.versions() == [2, 3] and {p.name for p in (tmp_path / "t/telematics").iterdir()} == {"v=1", "v=3"}
    assert {p.name for p in (tmp_path / "t/telematics/v=1").glob("part=*")} == {"part=2024-03", "part=2024-06"}
    batch(MILES + "V5,04/03/2024,1\n", 4)
    assert {p.name for p in (tmp_path / "t/telematics/v=1").glob("part=*")} == {"part=2024-06"}


def test_odometers_are_removed_and_run_on(spark):
    d = lambda n: dt.date(2024, 1, n)
    tel = spark.createDataFrame([(1, d(5), 50.0), (1, d(6), 0.0), (2, d(1), None)], "asset_id long, record_date date, odometer_km double")
    assets = spark.createDataFrame([(1, 7.0), (2, None), (3, 30.0)], "asset_id long, current_odometer double")
    at = lambda k: dt.datetime(2024, 2, 1, k)
    steps = [(1, at(0), "a", 0, "exec", d(7), 5.0), (1, at(1), "b", 0, "exec", d(7), None), (1, at(2), "c", 0, "mileage", d(2), 3.0), (1, at(2), "c", 1, "mileage", d(9), 4.0), (1, at(3), "d", 0, "exec", d(9), 1.0), (2, at(0), "a", 1, "exec", d(7), 5.0), (3, at(0), "a", 2, "exec", d(7), 5.0), (2, at(1), "m", 0, "mileage", d(1), 2.5)]
    got = {(r.asset_id, r.import_id, r.pos): r.odometer_km for r in odometers_in_order(spark.createDataFrame(steps, "asset_id long, received_at timestamp, import_id string, pos int, feed string, record_date date, distance double"), tel, assets).collect()}
    # 0 counts for a summary; b empties the day again; mileage takes the last that is not 0
    assert got == {(1, "a", 0): 5.0, (1, "b", 0): None, (1, "c", 0): 53.0, (1, "c", 1): 57.0, (1, "d", 0): 58.0, (2, "a", 1): None, (3, "a", 2): 35.0, (2, "m", 0): 2.5}


def test_rejects_do_not_meet_in_one_group(spark):
    cols = "import_id int, user_id int, asset_id int, card string, purchase_date date, litres double, cost double, product string, odometer double, pos int"
    df = resolve.clean_bp_transaction(spark.createDataFrame([(1, 1, None, "", None, None, None, "x", 0.0, k) for k in range(4)], cols))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # the window's keys end with a rejected row's own position
    assert "isnotnull(reject_reason" in text and text.count("Window [") == 1 and df.filter("reject_reason = 'bad_key'").count() == 4


def test_each_table_needs_its_own_steps_alone(spark, world, monkeypatch):
    """Assets need rows of the two formats that make them; what is asked for twice is stored once."""
    from axleyard.operators import ingest

    files, assets, ignored, old = world
    seen, store = [], ingest.stored
    monkeypatch.setattr(ingest, "stored", lambda df, *by: seen.append(df.columns) or store(df, *by))
    i = ingest_files(spark.createDataFrame(files, FILE), assets, ignored, old, spark.createDataFrame([], S.FUEL_PURCHASES), S.MAIL_ORDER)
    assert i.assets.filter("bp_card_number = 'C9'").count() == 1
    assert not any("reject_reason" in c or "vehicle_name" in c for c in seen) and sum("card" in c for c in seen) == 2
    n = len(seen)
    assert i.assets.count() and len(seen) == n
