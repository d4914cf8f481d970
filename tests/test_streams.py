import datetime as dt
import random

from axleyard.operators import intervals as I
from axleyard.streaming.intervals import stream_intervals

D = lambda n: dt.date(2024, 3, 1) + dt.timedelta(n)
ROW = "asset_id long, at timestamp, kind string, litres double, cost double, odometer_km double"


def test_intervals_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    fills = [(a, D(d), float(rng.randrange(20, 60)), 1.0) for a in range(4) for d in sorted(rng.choices(range(40), k=9))]
    tel = [(a, D(d), 10.0 * d + a) for a in range(4) for d in range(44) if rng.random() < 0.5]
    noon = lambda day: dt.datetime(day.year, day.month, day.day, 12)
    rows = [(a, noon(d), "fill", l, c, None) for a, d, l, c in fills] + [(a, noon(d), "odometer", None, None, o) for a, d, o in tel]
    # up to two days late
    rows.sort(key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(48)))
    # later rows let the watermark pass all of them
    parts = [rows[k : k + 60] for k in range(0, len(rows), 60)] + [[(99, noon(D(90 + k)), "odometer", None, None, 1.0)] for k in range(2)]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            s = stream_intervals(spark.readStream.schema(ROW).parquet(f"file://{tmp_path}/in"))
            s.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    p = spark.createDataFrame(fills, "vehicle_id long, purchase_date date, litres double, cost_nzd double")
    t = spark.createDataFrame(tel, "asset_id long, record_date date, odometer_km double")
    columns = ["asset_id", "seq", "start_date", "end_date", "litres", "start_odo", "end_odo"]
    got = sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out").select(*columns).collect()))
    want = sorted(map(str, I.intervals_with_odometers(p, t).select(*columns).collect()))
    assert got == want and len(got) == 32
