"""Fleet tables derived from the given tables, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch

#: In order: each may read the ones before it. {events} and so on stand for the given tables.
VIEWS: dict[str, str] = {
    "telematics": """
        SELECT asset_id % 7 AS user_id, asset_id, record_date, operating_hours,
          CASE WHEN (asset_id + day(record_date)) % 17 = 0 THEN NULL ELSE idle_hours END AS idle_hours,
          CASE WHEN asset_id % 5 = 0 THEN NULL ELSE 500e0 * (asset_id % 20) + sum(operating_hours) OVER (PARTITION BY asset_id ORDER BY record_date ROWS UNBOUNDED PRECEDING) END AS total_engine_hours,
          CASE WHEN (asset_id * 3 + day(record_date)) % 13 = 0 OR (asset_id % 10 = 3 AND day(record_date) BETWEEN 15 AND 17) THEN NULL
               ELSE 1000e0 * asset_id + sum(km) OVER (PARTITION BY asset_id ORDER BY record_date ROWS UNBOUNDED PRECEDING) END AS odometer_km,
          CASE WHEN asset_id % 7 = 2 THEN NULL ELSE operating_hours * 8e0 END AS litres_consumed
        FROM (SELECT user_id AS asset_id, cast(ts AS date) AS record_date,
            sum(CASE WHEN event_type = 'view' THEN value ELSE 0e0 END) / 20e0 AS operating_hours,
            sum(CASE WHEN event_type = 'click' THEN value ELSE 0e0 END) / 100e0 AS idle_hours,
            sum(CASE WHEN event_type IN ('view', 'click', 'signup') THEN value ELSE 0e0 END) AS km
          FROM {events} WHERE event_type <> 'purchase' GROUP BY user_id, cast(ts AS date)) d""",
    "fuel_purchases": """
        SELECT user_id % 7 AS user_id, user_id AS vehicle_id, cast(ts AS date) AS purchase_date, value AS litres, value * (1.5e0 + (event_id % 10) / 10e0) AS cost_nzd, cast(NULL AS double) AS odometer_reading, 'events' AS source
        FROM {events} WHERE event_type = 'purchase'""",
    "fuel_records": "SELECT user_id, vehicle_id AS asset_id, purchase_date AS record_date, litres FROM fuel_purchases",
    "assets": """
        SELECT a AS asset_id, a % 7 AS user_id,
          concat(CASE a % 6 WHEN 0 THEN 'Crane truck ' WHEN 1 THEN 'Hilux ute ' WHEN 2 THEN 'Hino ' WHEN 3 THEN 'Excavator ' WHEN 4 THEN 'Kenworth ' ELSE 'Forklift ' END, cast(a AS string)) AS asset_name,
          CASE WHEN a % 19 = 0 THEN NULL ELSE CASE a % 6 WHEN 0 THEN 'Crane' WHEN 1 THEN 'Light Vehicle' WHEN 2 THEN 'Rigid Truck' WHEN 3 THEN 'Excavator' WHEN 4 THEN 'Semi Trailer' ELSE 'Forklift' END END AS asset_type,
          CASE a % 5 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Petrol' WHEN 2 THEN 'Electric' WHEN 3 THEN NULL ELSE 'Hybrid' END AS fuel_type,
          a % 11 = 0 AS is_ignored, CASE WHEN a % 9 = 0 THEN true WHEN a % 9 = 1 THEN false ELSE NULL END AS is_on_road,
          concat('BP', cast(a AS string)) AS bp_card_number, CASE WHEN a % 2 = 0 THEN concat('MB', cast(a AS string)) ELSE NULL END AS mobil_card_number,
          CASE WHEN a % 8 = 1 THEN NULL ELSE 1000e0 * a END AS current_odometer, CASE WHEN a % 10 = 7 THEN NULL ELSE 20000e0 + 100e0 * a END AS current_value, CASE WHEN a % 12 = 5 THEN NULL ELSE 5000e0 + 200e0 * (a % 90) END AS estimated_end_of_life_value,
          CASE WHEN a % 13 = 4 THEN NULL ELSE 1000e0 * a + (a % 4) * 90e0 - 80e0 + (a % 3) * 40000e0 END AS expected_life_km, CASE WHEN a % 14 = 6 THEN NULL ELSE 2000e0 * (1 + a % 5) END AS expected_life_hours,
          CASE WHEN a % 9 = 8 THEN NULL ELSE 1000e0 + 10e0 * a END AS estimated_annual_repair_cost, CASE WHEN a % 7 = 3 THEN 0e0 WHEN a % 7 = 4 THEN NULL ELSE 20000e0 + a END AS estimated_annual_km,
          CASE WHEN a % 4 = 0 THEN NULL ELSE 30e0 + a % 20 END AS available_hours_per_week, CASE WHEN a % 3 = 0 THEN NULL WHEN a % 16 = 1 THEN 0e0 ELSE 20e0 + a % 70 END AS target_utilisation_percent,
          CASE WHEN a % 6 = 2 AND a % 4 = 0 THEN NULL ELSE 0.05e0 + (a % 10) / 100e0 END AS service_cost_per_km, CASE WHEN a % 15 = 3 THEN NULL ELSE 2e0 + (a % 10) / 10e0 END AS service_cost_per_hour,
          CASE WHEN a % 10 = 9 THEN NULL ELSE 1e0 + a % 40 END AS gvm_tonnes, CASE WHEN a % 2 = 0 THEN 0.1e0 + (a % 10) / 20e0 ELSE NULL END AS travel_rate_lpk, cast(NULL AS double) AS travel_rate_r2,
          CASE WHEN a % 4 = 1 THEN 0e0 WHEN a % 4 = 2 THEN NULL ELSE 1e0 + (a % 7) / 2e0 END AS idle_burn_rate_lph, a % 6 = 1 AS idle_anomaly_confirmed
        FROM (SELECT DISTINCT user_id AS a FROM {events}) u""",
    "holidays": "SELECT cast('2024-01-01' AS date) AS holiday_date UNION ALL SELECT cast('2024-01-02' AS date)",
    "settings": "SELECT DISTINCT user_id, concat('fleet', cast(user_id AS string)) AS upload_email, CASE WHEN user_id = 3 THEN NULL ELSE 1.5e0 + user_id / 10e0 END AS machinery_fuel_cost_per_litre FROM assets WHERE user_id <> 6",
    "members": "SELECT DISTINCT user_id % 50 AS account_owner_user_id, user_id AS member_auth_user_id, 'viewer' AS role FROM {events} WHERE user_id >= 50 AND user_id % 3 <> 0",
    "ignored": "SELECT user_id, asset_name FROM assets WHERE asset_id % 25 = 0",
    "jobs": "SELECT DISTINCT asset_id % 12 AS job_id, asset_id, record_date AS work_date, 10e0 + asset_id % 5 AS tonnes FROM telematics WHERE day(record_date) % 3 = 1",
    "trips": "SELECT cast(asset_id AS bigint) * 1000000 + (year(record_date) - 2000) * 10000 + month(record_date) * 100 + day(record_date) AS trip_id, asset_id, record_date AS start_date, record_date + 2 AS end_date, 1e0 + asset_id % 9 AS payload_tonnes FROM telematics WHERE (day(record_date) + asset_id) % 9 = 0",
    "ruc_rates": "SELECT 0e0 AS gvm_lo, 6e0 AS gvm_hi, 0.076e0 AS rate_per_km UNION ALL SELECT 6e0, 18e0, 0.12e0 UNION ALL SELECT 18e0, 35e0, 0.25e0",
    "card_rows": """
        SELECT {file_id} AS import_id, l_suppkey % 7 AS user_id, row_number() OVER (PARTITION BY {file_id} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS n,
          CASE l_partkey % 23 WHEN 0 THEN '' WHEN 1 THEN 'null' ELSE concat(CASE WHEN l_partkey % 2 = 0 THEN 'BP' ELSE 'ZZ' END, cast(l_partkey % 150 AS string)) END AS card,
          cast(l_shipdate AS date) AS purchase_date, l_quantity AS litres, CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_extendedprice / 1000e0 END AS cost,
          CASE l_linenumber WHEN 1 THEN 'NZ Diesel' WHEN 2 THEN 'NZ Ultimate' WHEN 3 THEN 'NZ Unleaded' WHEN 4 THEN 'NZ AdBlue' WHEN 5 THEN 'NZ Premium Unleaded' WHEN 6 THEN 'NZ Carwash' ELSE 'NZ Ultimate Diesel' END AS product,
          CASE l_partkey % 4 WHEN 0 THEN 'JOHN SMITH' WHEN 1 THEN concat('T', cast(l_partkey % 99 AS string)) WHEN 2 THEN '' ELSE concat('Hino, "big" ', cast(l_partkey % 9 AS string)) END AS description,
          CASE l_partkey % 3 WHEN 0 THEN 'Mary Jones' WHEN 1 THEN concat('D', cast(l_partkey % 77 AS string)) ELSE '' END AS driver,
          CASE WHEN l_partkey % 5 = 0 THEN concat('REG', cast(l_partkey % 60 AS string)) ELSE '' END AS registration,
          CASE WHEN l_orderkey % 6 = 0 THEN 0e0 WHEN l_orderkey % 6 = 1 THEN NULL ELSE l_orderkey * 10e0 END AS odometer, l_tax AS tax
        FROM {lineitem}""",
    "idle_rows": """
        SELECT user_id % 40 AS import_id, user_id % 7 AS user_id, event_id AS pos, user_id AS asset_id, cast(ts AS date) AS record_date, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value * 12e0 END AS duration,
          CASE event_id % 5 WHEN 0 THEN 'min' WHEN 1 THEN ' MIN ' WHEN 2 THEN '' WHEN 3 THEN 'h' ELSE 'min' END AS unit
        FROM {events} WHERE event_type IN ('click', 'view')""",
    "mileage_rows": """
        SELECT user_id % 40 AS import_id, user_id % 7 AS user_id, event_id AS pos, user_id AS asset_id, cast(ts AS date) AS record_date, CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0e0 ELSE value END AS distance
        FROM {events} WHERE event_type IN ('click', 'signup', 'error')""",
    "exec_rows": """
        SELECT asset_id % 40 AS import_id, asset_id % 7 AS user_id, asset_id AS source_id, CASE WHEN asset_id % 9 = 5 THEN NULL ELSE asset_id END AS asset_id, CASE WHEN asset_id % 13 = 0 THEN '' ELSE concat('V', cast(asset_id AS string)) END AS vehicle_name,
          CASE WHEN asset_id % 10 = 4 THEN 0e0 ELSE 60e0 * operating_hours + 30e0 END AS total_minutes, CASE WHEN asset_id % 8 = 3 THEN NULL ELSE 60e0 * idle_hours END AS idle_minutes,
          CASE WHEN asset_id % 6 = 2 THEN 0e0 ELSE 10e0 + asset_id END AS distance, record_date, row_number() OVER (PARTITION BY asset_id ORDER BY record_date) AS pos
        FROM telematics""",
    "named_rows": """
        SELECT c_custkey % 60 AS import_id, c_nationkey % 7 AS user_id, c_custkey AS pos, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE concat(CASE c_custkey % 4 WHEN 0 THEN 'Excavator ' WHEN 1 THEN 'Hino ' WHEN 2 THEN 'Hilux ute ' ELSE 'Bulldozer ' END, cast(c_custkey % 400 AS string)) END AS vehicle_name,
          CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('R', cast(c_custkey AS string)) END AS registration
        FROM {customer}""",
    "imports": """
        SELECT o_orderkey AS import_id, concat(CASE o_orderkey % 3 WHEN 0 THEN 'Upload <' WHEN 1 THEN '' ELSE ' ' END, CASE o_custkey % 9 WHEN 8 THEN 'NOBODY' WHEN 7 THEN 'other' ELSE concat('Fleet', cast(o_custkey % 7 AS string)) END, '@uploads.example.com', CASE o_orderkey % 3 WHEN 0 THEN '>' ELSE '' END) AS to_email, cast(o_orderdate AS date) AS received
        FROM {orders}""",
}
#: A supplier's file: one for each range of order keys.
FILE_ID = "(cast(l_suppkey AS bigint) * 1000000000 + cast(floor(l_orderkey / 100000e0) AS bigint))"
VIEWS["card_rows"] = VIEWS["card_rows"].replace("{file_id}", FILE_ID)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


#: Rows of a given table that one task makes files of.
TASK_ROWS = 100_000


def with_views(sql: str, places: dict[str, str] | None = None) -> str:
    """``sql`` below the views it needs; ``places``: how each given table is read (by its own name if not said)."""
    places = places or {t: t for t in TABLES}
    needed, text = [], sql
    for name in reversed(VIEWS):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += VIEWS[name]
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**places)})" for n in reversed(needed))
    return f"WITH {ctes}{', ' + sql.lstrip()[5:] if sql.lstrip()[:5].upper() == 'WITH ' else chr(10) + sql}"


class Fleet:
    """The views as DataFrames of one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        places = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES}
        return self.spark.sql(with_views(sql, places).format(**places))

    @property
    def card_rows(self) -> DataFrame:
        """The view over lineitem dealt by file: its row numbers, and files made of it, need no further exchange."""
        places = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES} | {"lineitem": "{lineitem}"}
        dealt = self.table("lineitem").repartition(self._tasks("lineitem"), F.expr(FILE_ID))
        return self.spark.sql(with_views("SELECT * FROM card_rows", places), lineitem=dealt)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def scratch(self) -> str:
        """A new folder in the shared checkpoint folder."""
        return scratch(self.spark)

    def _tasks(self, name: str) -> int:
        """As many tasks as there are cores at least, as parsing a file costs far more than its bytes tell; more where the table is large, so that a task's sort fits in memory at any size."""
        most = math.ceil(self.table(name).count() / TASK_ROWS)
        return max(2 * self.spark.sparkContext.defaultParallelism, most)

    def _spread(self, rows: DataFrame) -> DataFrame:
        """``rows`` by file."""
        return rows.repartition(self._tasks("events"), "import_id")

    def card_files(self) -> DataFrame:
        """Card rows as files (import_id, user_id, raw_csv): preamble, byte order mark, quotes, CRLF, blank lines, a repeated header. A file holds orders of a bounded range of keys, so a large supplier has many files."""
        return self.card_reports(self.card_rows, ["bp_transaction"]).drop("kind")

    def card_reports(self, rows: DataFrame, kinds: list[str]) -> DataFrame:
        """``rows``, dealt by file, as a file (import_id, user_id, kind, raw_csv) of each of ``kinds``: rows are dealt, sorted and gathered once for all of them."""
        always = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
        q = lambda c: F.when(F.contains(c, F.lit(",")) | F.contains(c, F.lit('"')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        day = F.concat_ws("/", F.day("purchase_date"), F.month("purchase_date"), F.year("purchase_date"))
        iso = F.col("purchase_date").cast("string")
        lines = {
            "bp_transaction": lambda: F.concat_ws(",", day, F.concat(F.lit(" "), s("card")), s("litres"), s("cost"), always("product"), always("description"), s("registration"), s("driver"), s("odometer"), s("tax"), F.lit("extra")),
            "mobil": lambda: F.concat_ws(",", F.coalesce(F.concat_ws("/", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4)), F.lit("")), q(s("mobil_card")), q(s("description")), s("litres"), s("cost"), s("gst"), q(s("mobil_product")), s("odometer")),
            "bp": lambda: F.concat_ws(",", day, q(s("card")), s("litres"), F.coalesce(F.concat(F.lit("$"), F.col("cost").cast("string")), F.lit("")), q(s("product")), q(s("driver"))),
        }
        text = {
            "bp_transaction": lambda ls: F.concat(F.lit("Card report\r\n\r\n﻿Transaction Effective Date,Card Number,Litres,Customer Value ($),Product,\"Vehicle Description\",Vehicle Registration Number,Driver Name,Transaction Odometer Reading,Tax\r\n,,,,\r\n   \r\n"), F.concat_ws("\r\n", ls), F.lit("\r\n")),
            "mobil": lambda ls: F.concat(F.lit("Transaction Date,Card No.,Description,Quantity,Total,GST,Product Description,Odometer\n"), F.concat_ws("\n", ls)),
            "bp": lambda ls: F.concat(F.lit("Transaction Effective Date,Card Number,Litres,Customer Value ($),Product,Driver Name\n"), F.concat_ws("\n", ls)),
        }
        # the one-row inline keeps lines out of the aggregate, which would make them by interpretation
        made = rows.select("import_id", "user_id", F.inline(F.array(F.struct("n", *(lines[k]().alias(k) for k in kinds)))))
        g = made.groupBy("import_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("n", *kinds))).alias("ls"))
        file = lambda k: F.struct(F.lit(k).alias("kind"), text[k](F.transform("ls", lambda x: x[k])).alias("raw_csv"))
        return g.select("import_id", "user_id", F.inline(F.array(*map(file, kinds))))

    def _files(self, rows: DataFrame, key: list[str], order: str, header: str, *cells) -> DataFrame:
        """``rows``, dealt by file, as files: one for each ``key``, a header and a line for each row by ``order``. Keys are fine enough that files stay small."""
        q = lambda c: F.when(F.contains(c, F.lit(",")) | F.contains(c, F.lit('"')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        line = F.concat_ws(",", *(q(F.coalesce(c.cast("string"), F.lit(""))) for c in cells))
        g = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("ls"))
        return g.select(*key, F.concat(F.lit(header + "\n"), F.concat_ws("\n", F.transform("ls", lambda x: x["line"]))).alias("raw_csv"))

    def idle_files(self) -> DataFrame:
        """Idle events as files of an asset's month."""
        rows = self.idle_rows.withColumn("import_id", F.col("asset_id") * 100_000 + F.year("record_date") % 1000 * 100 + F.month("record_date"))
        at = lambda t: F.concat(F.date_format("record_date", "d/MM/yyyy"), F.lit(t))
        return self._files(self._spread(rows), ["import_id", "user_id"], "pos", "Vehicle,IdleStart,IdleEnd,Duration,Unit", F.concat(F.lit("V"), F.col("asset_id")), at(" 09:30"), at(" 10:00"), F.col("duration"), F.col("unit"))

    def exec_files(self) -> DataFrame:
        """Executive summaries as files of a day, an account and a range of assets; the name tells the day."""
        rows = self.exec_rows.withColumn("import_id", (F.floor(F.col("source_id") / 10_000) * 10 + F.col("user_id")) * 100_000 + F.datediff("record_date", F.lit("2000-01-01")))
        f = self._files(self._spread(rows), ["import_id", "user_id", "record_date"], "source_id", "VehicleName,TotalHours,IdleTime,AverageDailyIgnitionTime", F.col("vehicle_name"), F.col("total_minutes"), F.col("idle_minutes"), F.col("distance"))
        return f.withColumn("filename", F.concat(F.lit("summary_"), F.date_format("record_date", "yyyy_MM_dd"), F.lit(".csv"))).drop("record_date")

    def mobil_files(self, rows: DataFrame) -> DataFrame:
        """Card rows with mobil_card, mobil_product and gst as Mobil's exports."""
        return self.card_reports(rows, ["mobil"]).drop("kind")

    def bp_files(self) -> DataFrame:
        """Card rows as plain exports: no vehicle column, costs with a currency sign."""
        return self.card_reports(self.card_rows, ["bp"]).drop("kind")

    def mileage_files(self) -> DataFrame:
        """Mileage rows as files (import_id, user_id, raw_csv)."""
        line = F.concat_ws(",", F.concat(F.lit("V"), F.col("asset_id").cast("string")), F.date_format("record_date", "dd/MM/yyyy"), F.coalesce(F.col("distance").cast("string"), F.lit("")))
        g = self._spread(self.mileage_rows.withColumn("import_id", F.col("asset_id"))).groupBy("import_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))
        return g.select("import_id", "user_id", F.concat(F.lit("Vehicle,ActivityDate,ActualDistance\n"), F.concat_ws("\n", F.transform("ls", lambda x: x["line"]))).alias("raw_csv"))
