"""Queries of file ingest, entity resolution, cleaning, upserts and streams.

Files are made from the tables' rows, so the SQL side reads the rows they were made from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..operators import resolve
from ..operators import telematics as T
from ..operators import upsert as U
from ..operators.ingest import MADE, ingest_files
from ..sources import files as Z
from ..sources import records as R
from ..streaming import jobs
from .base import query
from .daily import EMISSIONS, MILEAGE, emissions_daily
from .fixtures import Fleet

_FEED = "concat('V', cast(asset_id AS string))"


def _delivered(files, path: str) -> None:
    """Each of ``files``, which are dealt by import_id, as a file in a folder of its own."""
    files.select("import_id", "raw_csv").write.options(**Z.MANY_FILES).option("lineSep", " ").partitionBy("import_id").text(path)


@query("read_raw_files", "SELECT import_id, count(*) + 5 AS n_lines FROM card_rows GROUP BY import_id")
def _(f: Fleet):
    path = f.scratch()
    _delivered(f.card_files(), path)
    got = Z.read_raw_files(f.spark, path).withColumn("import_id", F.regexp_extract(F.input_file_name(), r"import_id=(\d+)", 1).cast("long"))
    lines = F.filter(Z.lines_of(F.col("raw_csv")), lambda l: X.js_trim(l) != "")
    return got.groupBy("import_id").agg(F.sum(F.size(lines) + 2).alias("n_lines"))


_MIME = "CASE o_orderkey % 7 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/vnd.ms-excel' WHEN 2 THEN 'TEXT/CSV' ELSE 'application/octet-stream' END"
_FILE = "concat('file', cast(o_orderkey AS string), CASE o_orderkey % 5 WHEN 0 THEN '.CSV' WHEN 1 THEN '.xls' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pdf' ELSE '' END)"
_KIND = "CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 IN (0, 2) THEN 'csv' WHEN o_orderkey % 5 IN (1, 2) OR o_orderkey % 7 = 1 THEN 'xls' END"


@query("attachment_filter", f"SELECT o_orderkey, {_KIND} AS kind FROM orders")
def _(f: Fleet):
    return f.table("orders").select("o_orderkey", Z.attachment_kind(F.expr(_FILE), F.expr(_MIME)).alias("kind"))


@query("archive_raw", f"SELECT o_orderkey, CASE WHEN {_KIND} = 'xls' THEN concat('BASE64_XLS:', base64(encode(repeat(concat('row ', o_orderpriority, chr(10)), 20)))) ELSE repeat(concat('row ', o_orderpriority, chr(10)), 20) END AS raw_csv, 'pending' AS status FROM orders WHERE {_KIND} IS NOT NULL")
def _(f: Fleet):
    o = f.table("orders").select("o_orderkey", F.expr(_KIND).alias("kind"), F.encode(F.repeat(F.concat(F.lit("row "), "o_orderpriority", F.lit("\n")), F.lit(20)), "UTF-8").alias("content"))
    return Z.archive_raw(o.filter("kind is not null")).select("o_orderkey", "raw_csv", "status")


@query("split_lines", "SELECT import_id, n + 4 AS pos, 11 AS n_fields FROM card_rows UNION ALL SELECT DISTINCT import_id, 0, 1 FROM card_rows UNION ALL SELECT DISTINCT import_id, 2, 10 FROM card_rows")
def _(f: Fleet):
    return Z.split_lines(f.card_files()).select("import_id", "pos", F.size("fields").alias("n_fields"))


@query("parse_csv_line", "SELECT import_id, n, product, description, driver FROM card_rows")
def _(f: Fleet):
    s = Z.split_lines(f.card_files()).filter("pos > 4")
    return s.select("import_id", (F.col("pos") - 4).alias("n"), F.get("fields", F.lit(4)).alias("product"), F.get("fields", F.lit(5)).alias("description"), F.get("fields", F.lit(7)).alias("driver"))


@query("normalize_header", "SELECT DISTINCT import_id, 'Transaction Effective Date|Card Number|Vehicle Description' AS header FROM card_rows")
def _(f: Fleet):
    h = Z.normalize_header(Z.parse_csv_line(F.get(Z.lines_of(F.col("raw_csv")), F.lit(2))))
    return f.card_files().select("import_id", F.concat_ws("|", F.get(h, F.lit(0)), F.get(h, F.lit(1)), F.get(h, F.lit(5))).alias("header"))


_HEADS = {
    0: "VehicleName,TotalHours,IdleTime,AverageDailyIgnitionTime", 1: 'Transaction Effective Date,Card Number,Litres,Customer Value ($),"Vehicle Description"', 2: "Transaction Effective Date,Card Number,Litres,Customer Value ($),Product",
    3: "Transaction Date,Card No.,Description,Quantity,Total,GST,Product Description", 4: "Vehicle,ActivityDate,ActualDistance,IdleStart,IdleEnd,Duration", 5: "Vehicle,IdleStart,IdleEnd,Duration", 6: "Trip,Odometer,Litres", 7: "Machine Name,Engine Hours,Litres", 8: "a,b,c",
}


def _head_files(f: Fleet):
    """One small file for each order: a format by key, behind 0 to 13 other lines."""
    head = F.get(F.array(*(F.lit(h) for h in _HEADS.values())), (F.col("o_orderkey") % 9).cast("int"))
    pad = (F.col("o_custkey") % 14).cast("int")
    return f.table("orders").select("o_orderkey", F.concat(F.repeat(F.lit("\r\n"), pad), head, F.lit("\r\n1,2,3\r\n")).alias("raw_csv"))


_PAD = "o_custkey % 14"


_FORMAT = "CASE o_orderkey % 9 WHEN 0 THEN 'exec_summary' WHEN 1 THEN 'bp_transaction' WHEN 2 THEN 'bp' WHEN 3 THEN 'mobil' WHEN 4 THEN 'mileage' WHEN 5 THEN 'idle' ELSE 'unknown' END"
_LIMITED = f"CASE WHEN o_orderkey % 9 IN (4, 5) AND {_PAD} >= 10 THEN 'unknown' ELSE {_FORMAT} END"


@query("detect_format", f"SELECT o_orderkey, {_LIMITED} AS format, CASE WHEN {_LIMITED} <> 'unknown' THEN {_PAD} END AS header_pos FROM orders")
def _(f: Fleet):
    return Z.detect_format(_head_files(f)).select("o_orderkey", "format", "header_pos")


@query("dispatch_format", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'exec_summary' WHEN o_orderkey % 3 = 0 THEN 'bp' WHEN o_orderkey % 5 = 0 THEN 'mileage' WHEN o_orderkey % 7 = 0 THEN 'idle' ELSE 'unknown' END AS mail,
  CASE WHEN o_orderkey % 5 = 0 THEN 'mileage' WHEN o_orderkey % 7 = 0 THEN 'idle' WHEN o_orderkey % 2 = 0 THEN 'exec_summary' WHEN o_orderkey % 3 = 0 THEN 'bp' ELSE 'unknown' END AS bulk FROM orders""")  # fmt: skip
def _(f: Fleet):
    at = {"exec_summary": 2, "bp": 3, "mileage": 5, "idle": 7}
    m = f.table("orders").select("o_orderkey", *(F.when(F.col("o_orderkey") % at[n] == 0, 1).alias(f"_at_{n}") if n in at else F.lit(None).cast("int").alias(f"_at_{n}") for n in S.SIGNATURES))
    mail = Z.dispatch_format(m, S.MAIL_ORDER).withColumnRenamed("format", "mail")
    return Z.dispatch_format(mail, S.BULK_ORDER).select("o_orderkey", "mail", F.col("format").alias("bulk"))


@query("classify_unknown", f"""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'unknown' WHEN 1 THEN 'fuel_provider' WHEN 2 THEN 'fuel_provider' WHEN 3 THEN 'unknown' WHEN 4 THEN 'on_road_telematics' WHEN 5 THEN 'unknown' WHEN 6 THEN 'on_road_telematics' WHEN 7 THEN 'oem_machinery_telematics' ELSE 'unknown' END AS category, o_orderkey % 9 AS kind FROM orders WHERE {_PAD} < 30""")
def _(f: Fleet):
    category, header = Z.classify_unknown(F.col("raw_csv"))
    return _head_files(f).filter(header != "").select("o_orderkey", category.alias("category"), (F.col("o_orderkey") % 9).alias("kind"))


def _card_records(f: Fleet):
    """Card files parsed back to typed rows."""
    r = _typed(f.card_files(), "bp_transaction")
    return r.withColumn("line_pos", F.col("pos")).withColumn("pos", F.col("pos") - 4)


def _typed(files, name: str):
    """The rows of one format of files that lack a name and a time."""
    have = {"filename": F.lit("report.csv"), "received_at": F.lit("2024-06-30 12:00:00").cast("timestamp")}
    return R.typed_rows(Z.detect_format(files.withColumns({k: v for k, v in have.items() if k not in files.columns})), name)


@query("read_idle_events", "SELECT concat('V', cast(asset_id AS string)) AS vehicle_name, record_date, duration, trim(unit) AS unit, count(*) AS n FROM idle_rows GROUP BY ALL", "duration")
def _(f: Fleet):
    return _typed(f.idle_files(), "idle").groupBy("vehicle_name", "record_date", "duration", "unit").agg(F.count("*").alias("n"))


@query("read_exec_summary", "SELECT source_id, vehicle_name, record_date, total_minutes, idle_minutes, distance FROM exec_rows WHERE vehicle_name <> ''", "total_minutes idle_minutes distance")
def _(f: Fleet):
    r = _typed(f.exec_files(), "exec_summary").filter("vehicle_name <> ''")
    return r.select(F.regexp_extract("vehicle_name", r"\d+", 0).cast("long").alias("source_id"), "vehicle_name", "record_date", "total_minutes", "idle_minutes", "distance")


@query("read_mileage", "SELECT asset_id, record_date, distance, count(*) AS n FROM mileage_rows GROUP BY ALL", "distance")
def _(f: Fleet):
    r = _typed(f.mileage_files(), "mileage")
    return r.groupBy(F.substring("vehicle_name", 2, 20).cast("long").alias("asset_id"), "record_date", "distance").agg(F.count("*").alias("n"))


@query("read_bp", "SELECT import_id, n AS pos, card, purchase_date, litres, cost, product, driver FROM card_rows", "litres cost")
def _(f: Fleet):
    return _typed(f.bp_files(), "bp").select("import_id", "pos", "card", "purchase_date", "litres", "cost", "product", "driver")


@query("rows_to_record", "SELECT import_id, n AS pos, card, purchase_date, litres, cost, product, trim(description) AS description, driver, registration, odometer FROM card_rows", "litres cost odometer")
def _(f: Fleet):
    return _card_records(f).select("import_id", "pos", "card", "purchase_date", "litres", "cost", "product", "description", "driver", "registration", "odometer")


@query("read_oem_csv", "SELECT asset_name, record_date, total_engine_hours, operating_hours, idle_hours, litres_consumed, odometer_km FROM telematics JOIN assets USING (asset_id)", "total_engine_hours operating_hours idle_hours litres_consumed odometer_km")
def _(f: Fleet):
    path = f.scratch()
    t = f.telematics.join(f.assets.select("asset_id", "asset_name"), "asset_id")
    t.select("asset_name", "record_date", "total_engine_hours", "operating_hours", "idle_hours", "litres_consumed", "odometer_km").write.option("header", True).csv(path)
    return Z.read_oem_csv(f.spark, path)


@query("export_daily_csv", f"SELECT lower(replace(asset_name, ' ', '-')) AS asset_slug, cast(record_date AS varchar) AS day, printf('%.2f', litres) AS litres FROM ({EMISSIONS}) e")
def _(f: Fleet):
    path = f.scratch()
    Z.export_daily_csv(emissions_daily(f), path)
    back = f.spark.read.option("header", True).csv(path)
    return back.select("asset_slug", F.col("Date").cast("string").alias("day"), F.col("`Fuel (L)`").alias("litres"))


_TARGET = "SELECT user_id, asset_id, record_date, operating_hours, idle_hours, total_engine_hours, odometer_km, litres_consumed FROM telematics"


@query("upsert_telematics", f"""SELECT asset_id, record_date, coalesce(t.user_id, u.user_id) AS user_id, operating_hours, idle_hours, CASE WHEN u.asset_id IS NOT NULL THEN u.distance ELSE odometer_km END AS odometer_km, CASE WHEN u.asset_id IS NOT NULL THEN NULL ELSE litres_consumed END AS litres_consumed
  FROM ({_TARGET}) t FULL JOIN (SELECT asset_id, record_date, user_id, distance FROM mileage_rows QUALIFY row_number() OVER (PARTITION BY asset_id, record_date ORDER BY pos DESC) = 1) u USING (asset_id, record_date)""", "operating_hours idle_hours odometer_km litres_consumed")  # fmt: skip
def _(f: Fleet):
    u = f.mileage_rows.select("user_id", "asset_id", "record_date", F.col("distance").alias("odometer_km"), F.lit(None).cast("double").alias("litres_consumed"), "pos")
    return U.upsert_telematics(f.sql(_TARGET), u, ["odometer_km", "litres_consumed"]).select("asset_id", "record_date", "user_id", "operating_hours", "idle_hours", "odometer_km", "litres_consumed")


@query("upsert_fuel", """SELECT vehicle_id, purchase_date, litres, max_by(cost_nzd, b) AS cost_nzd FROM (SELECT vehicle_id, purchase_date, litres, max(cost_nzd) AS cost_nzd, -1 AS b FROM fuel_purchases GROUP BY ALL
  UNION ALL SELECT vehicle_id, purchase_date, CASE WHEN vehicle_id % 2 = 0 THEN litres ELSE litres + 1 END, max(cost_nzd) + 100, 5 FROM fuel_purchases GROUP BY ALL) x GROUP BY ALL""", "litres cost_nzd")  # fmt: skip
def _(f: Fleet):
    old = f.fuel_purchases.groupBy("user_id", "vehicle_id", "purchase_date", "litres", "odometer_reading", "source").agg(F.max("cost_nzd").alias("cost_nzd"))
    new = old.withColumn("litres", F.when(F.col("vehicle_id") % 2 == 0, F.col("litres")).otherwise(F.col("litres") + 1)).withColumn("cost_nzd", F.col("cost_nzd") + 100).withColumn("batch_seq", F.lit(5))
    return U.upsert_fuel(old, new).select("vehicle_id", "purchase_date", "litres", "cost_nzd")


@query("insert_ignore", "SELECT user_id, vehicle_name, min(pos) AS pos FROM named_rows WHERE (user_id, vehicle_name) NOT IN (SELECT user_id, asset_name FROM assets) GROUP BY ALL")
def _(f: Fleet):
    target = f.assets.select("user_id", F.col("asset_name").alias("vehicle_name"))
    return U.insert_ignore(target, f.named_rows, ["user_id", "vehicle_name"]).select("user_id", "vehicle_name", "pos")


#: c1: card rows with their asset by card.
_C1 = "c1 AS (SELECT c.*, a.asset_id FROM card_rows c LEFT JOIN (SELECT user_id, bp_card_number AS card, max(asset_id) AS asset_id FROM assets GROUP BY ALL) a ON a.user_id = c.user_id AND a.card = c.card)"
_FUEL = "product IN ('NZ Diesel', 'NZ Ultimate Diesel', 'NZ Ultimate', 'NZ Premium Unleaded', 'NZ Unleaded')"
_CLEAN = f"""{_C1}, c2 AS (SELECT *, CASE WHEN card = '' OR litres <= 0 THEN 'bad_key' WHEN cost IS NULL THEN 'no_cost' WHEN NOT {_FUEL} THEN 'not_fuel' WHEN cost / litres < 0.5e0 OR cost / litres > 6 THEN 'price_out_of_band' WHEN asset_id IS NULL THEN 'no_asset' END AS r FROM c1),
  c3 AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY import_id, asset_id, purchase_date, litres, r IS NULL ORDER BY n) > 1 THEN 'duplicate' ELSE r END AS reject_reason FROM c2)"""


def _cleaned(f: Fleet):
    return resolve.clean_bp_transaction(resolve.join_by_card(_card_records(f), f.assets))


@query("join_assets_by_card", f"WITH {_C1} SELECT import_id, n AS pos, asset_id FROM c1")
def _(f: Fleet):
    return resolve.join_by_card(_card_records(f), f.assets).select("import_id", "pos", "asset_id")


@query("join_assets_by_name", "SELECT pos, n.user_id, asset_id FROM named_rows n LEFT JOIN (SELECT user_id, asset_name, max(asset_id) AS asset_id FROM assets GROUP BY ALL) a ON a.user_id = n.user_id AND a.asset_name = n.vehicle_name")
def _(f: Fleet):
    return resolve.join_by_name(f.named_rows, f.assets).select("pos", "user_id", "asset_id")


@query("clean_bp_transaction", f"WITH {_CLEAN} SELECT import_id, n AS pos, asset_id, reject_reason, CASE WHEN odometer > 0 THEN odometer END AS odometer_reading, cost AS cost_nzd FROM c3", "odometer_reading cost_nzd")
def _(f: Fleet):
    return _cleaned(f).select("import_id", "pos", "asset_id", "reject_reason", "odometer_reading", "cost_nzd")


@query("dedup_fuel_rows", f"WITH {_CLEAN} SELECT user_id, asset_id AS vehicle_id, purchase_date, litres, cost AS cost_nzd FROM c3 WHERE reject_reason IS NULL", "litres cost_nzd")
def _(f: Fleet):
    return resolve.fuel_purchases(_cleaned(f)).select("user_id", "vehicle_id", "purchase_date", "litres", "cost_nzd")


_MOBIL = "CASE n % 5 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Shop' WHEN 2 THEN 'Unleaded 91' WHEN 3 THEN 'Mobil Diesel Efficient' ELSE 'Car Wash' END"


def _as_mobil(rows):
    """Card rows with what Mobil's exports have of their own."""
    return rows.withColumns({"mobil_card": F.regexp_replace("card", "^BP", "MB"), "mobil_product": F.expr(_MOBIL), "gst": F.when(F.col("n") % 3 != 0, F.col("tax"))})


def _mobil(f: Fleet):
    r = f.card_rows.withColumn("product", F.expr(_MOBIL)).withColumnRenamed("n", "pos").withColumn("card", F.regexp_replace("card", "^BP", "MB")).withColumnRenamed("cost", "total").withColumn("gst", F.when(F.col("pos") % 3 != 0, F.col("tax")))
    return r


@query("clean_mobil", f"""WITH m1 AS (SELECT c.*, a.asset_id, {_MOBIL} AS p, cost - CASE WHEN n % 3 <> 0 THEN tax ELSE 0 END AS c2 FROM card_rows c LEFT JOIN (SELECT user_id, mobil_card_number AS card, max(asset_id) AS asset_id FROM assets GROUP BY ALL) a ON a.user_id = c.user_id AND a.card = regexp_replace(c.card, '^BP', 'MB')),
  m2 AS (SELECT *, CASE WHEN card = '' OR litres <= 0 THEN 'bad_key' WHEN c2 IS NULL THEN 'no_cost' WHEN p IN ('Shop', 'Car Wash') THEN 'not_fuel' WHEN c2 / litres < 0.5e0 OR c2 / litres > 6 THEN 'price_out_of_band' WHEN asset_id IS NULL THEN 'no_asset' END AS r FROM m1)
  SELECT import_id, n AS pos, c2 AS cost_nzd, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY import_id, asset_id, purchase_date, litres, r IS NULL ORDER BY n) > 1 THEN 'duplicate' ELSE r END AS reject_reason FROM m2""", "cost_nzd")  # fmt: skip
def _(f: Fleet):
    return resolve.clean_mobil(resolve.join_by_card(_mobil(f), f.assets, "mobil_card_number")).select("import_id", "pos", "cost_nzd", "reject_reason")


@query("read_mobil", f"SELECT import_id, n AS pos, regexp_replace(card, '^BP', 'MB') AS card, purchase_date, litres, cost AS total, CASE WHEN n % 3 <> 0 THEN tax END AS gst, {_MOBIL} AS product, trim(description) AS description, odometer FROM card_rows", "litres total gst odometer")
def _(f: Fleet):
    return _typed(f.mobil_files(_as_mobil(f.card_rows)), "mobil").select("import_id", "pos", "card", "purchase_date", "litres", "total", "gst", "product", "description", "odometer")


#: Minutes after ten at which each kind of file comes in: plain card exports first, so that their cards are unseen.
_CAME = {"bp": 0, "bp_transaction": 1, "mobil": 2, "mileage": 3, "idle": 4, "exec_summary": 5, "unknown": 6}
_IGNORED = "SELECT user_id, concat('d', cast(asset_id AS string)) AS asset_name FROM assets WHERE asset_id % 3 = 0 UNION ALL SELECT user_id, concat(' V', cast(asset_id AS string)) FROM assets WHERE asset_id % 26 = 0"
#: va: assets there are. j: card rows of all three feeds (kind f) with their asset, by number or as 'new' and its card. rows_: every parsed row.
_FOLDER = f"""va AS MATERIALIZED (SELECT * FROM assets WHERE asset_id % 13 <> 0), cr AS MATERIALIZED (SELECT * FROM card_rows), ign AS MATERIALIZED (SELECT user_id, lower(trim(asset_name)) AS nm, trim(asset_name) AS exact FROM ({_IGNORED}) i),
  st AS MATERIALIZED (SELECT card, arg_min(user_id, (import_id, n)) AS user_id, arg_min(CASE WHEN description NOT IN ('', 'JOHN SMITH') THEN trim(description) WHEN driver NOT IN ('', 'Mary Jones') THEN driver ELSE concat('Card ••••', right(card, 4)) END, (import_id, n)) AS name FROM cr WHERE card NOT IN ('', 'null') AND card NOT IN (SELECT bp_card_number FROM va) GROUP BY card),
  kv AS MATERIALIZED (SELECT user_id, bp_card_number AS card, cast(max(asset_id) AS varchar) AS k FROM va GROUP BY ALL), ka AS MATERIALIZED (SELECT * FROM kv UNION ALL SELECT user_id, card, concat('new ', card) FROM st),
  km AS MATERIALIZED (SELECT user_id, mobil_card_number AS card, cast(max(asset_id) AS varchar) AS k FROM va WHERE mobil_card_number IS NOT NULL GROUP BY ALL),
  mr AS MATERIALIZED (SELECT *, regexp_replace(card, '^BP', 'MB') AS mc, {_MOBIL} AS p, cost - CASE WHEN n % 3 <> 0 THEN tax ELSE 0 END AS c2 FROM cr),
  j AS MATERIALIZED (SELECT 1 AS f, c.import_id, n, c.user_id, purchase_date, litres, cost AS c2, ka.k, CASE WHEN c.card = '' OR litres <= 0 THEN 'bad_key' WHEN cost IS NULL THEN 'no_cost' WHEN NOT {_FUEL} THEN 'not_fuel' WHEN cost / litres < 0.5e0 OR cost / litres > 6 THEN 'price_out_of_band' WHEN k IS NULL THEN 'no_asset' END AS r FROM cr c LEFT JOIN ka ON ka.user_id = c.user_id AND ka.card = c.card
    UNION ALL SELECT 2, m.import_id, n, m.user_id, purchase_date, litres, c2, coalesce(km.k, CASE WHEN m.card NOT IN ('', 'null') THEN concat('new mobil ', mc) END) AS k2, CASE WHEN m.card = '' OR litres <= 0 THEN 'bad_key' WHEN c2 IS NULL THEN 'no_cost' WHEN p IN ('Shop', 'Car Wash') THEN 'not_fuel' WHEN c2 / litres < 0.5e0 OR c2 / litres > 6 THEN 'price_out_of_band' WHEN k2 IS NULL THEN 'no_asset' END FROM mr m LEFT JOIN km ON km.user_id = m.user_id AND km.card = m.mc
    UNION ALL SELECT 7, c.import_id, n, c.user_id, purchase_date, litres, cost, kv.k, CASE WHEN c.card = '' THEN 'no_card' WHEN kv.k IS NULL THEN 'no_asset' WHEN NOT {_FUEL} THEN 'not_fuel' WHEN cost IS NOT NULL AND litres > 0 AND (cost / litres < 0.5e0 OR cost / litres > 6) THEN 'price_out_of_band' END FROM cr c LEFT JOIN kv ON kv.user_id = c.user_id AND kv.card = c.card),
  jr AS MATERIALIZED (SELECT *, CASE WHEN r IS NULL AND f <> 7 AND row_number() OVER (PARTITION BY f, import_id, k, purchase_date, litres, r IS NULL ORDER BY n) > 1 THEN 'duplicate' ELSE r END AS r2 FROM j),
  cardless AS MATERIALIZED (SELECT import_id, user_id, card, arg_min(CASE WHEN driver <> '' THEN driver ELSE card END, (CASE WHEN driver <> '' THEN 0 ELSE 1 END, n)) AS asset_name, min(n) AS n FROM cr WHERE card <> '' AND (user_id, card) NOT IN (SELECT user_id, bp_card_number FROM va) GROUP BY ALL),
  unseen AS MATERIALIZED (SELECT 0 AS came, 7 AS f, import_id, c.user_id, asset_name, n, 'bp' AS source, card AS t FROM cardless c WHERE (user_id, lower(asset_name)) NOT IN (SELECT user_id, nm FROM ign)
    UNION ALL SELECT 3, 3, asset_id, user_id, concat('V', cast(asset_id AS varchar)) AS v, 0, 'navman-mileage', '' FROM mileage_rows WHERE asset_id % 13 = 0 AND (user_id, v) NOT IN (SELECT user_id, exact FROM ign) GROUP BY ALL
    UNION ALL SELECT 4, 4, asset_id * 100000 + year(record_date) % 1000 * 100 + month(record_date), user_id, concat('V', cast(asset_id AS varchar)) AS v, 0, 'navman-idle', '' FROM idle_rows WHERE asset_id % 13 = 0 AND (user_id, v) NOT IN (SELECT user_id, exact FROM ign) GROUP BY ALL),
  rows_ AS (SELECT f, import_id, r2 AS r FROM jr
    UNION ALL SELECT 3, asset_id, CASE WHEN distance IS NULL OR distance <= 0 THEN 'bad_row' WHEN asset_id % 13 = 0 THEN 'no_asset' END FROM mileage_rows
    UNION ALL SELECT 4, asset_id * 100000 + year(record_date) % 1000 * 100 + month(record_date), CASE WHEN duration IS NULL OR duration <= 0 OR lower(trim(unit)) NOT IN ('', 'min') THEN 'bad_row' WHEN asset_id % 13 = 0 THEN 'no_asset' END FROM idle_rows
    UNION ALL SELECT 5, (source_id // 10000 * 10 + user_id) * 100000 + date_diff('day', date '2000-01-01', record_date), CASE WHEN vehicle_name = '' OR total_minutes = 0 THEN 'bad_row' END FROM exec_rows)"""


def _folder(f: Fleet):
    """One folder of files of all formats, and what it is taken in over."""
    kinds = ("bp_transaction", "mobil", "mileage", "idle", "exec_summary", "unknown", "bp")
    unknown = f.table("nation").select(F.col("n_nationkey").alias("import_id"), F.lit(0).cast("long").alias("user_id"), F.concat_ws(",", "n_name", F.lit("x")).alias("raw_csv"))
    parts = {"mileage": f.mileage_files(), "idle": f.idle_files(), "exec_summary": f.exec_files(), "unknown": unknown}
    files = None
    for p in (f.card_reports(_as_mobil(f.card_rows), ["bp_transaction", "mobil", "bp"]), *(p.withColumn("kind", F.lit(kind)) for kind, p in parts.items())):
        name = F.col("filename") if "filename" in p.columns else F.lit("report.csv")
        number, minute = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.get(F.array(*(F.lit(_CAME[k]) for k in kinds)), (F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).cast("int"))
        came = F.lit("2024-06-30 10:00:00").cast("timestamp") + F.make_dt_interval(mins=minute)
        p = p.select((F.col("import_id").cast("long") * 10 + number).alias("import_id"), F.col("user_id").cast("long").alias("user_id"), name.alias("filename"), came.alias("received_at"), "raw_csv")
        files = p if files is None else files.unionByName(p)
    assets = f.assets.filter("asset_id % 13 <> 0").select("asset_id", "user_id", F.expr(_FEED).alias("asset_name"), "asset_type", "fuel_type", "bp_card_number", "mobil_card_number", "current_odometer")
    return files, assets, f.sql(_IGNORED), f.sql(_TARGET), f.fuel_purchases.limit(0)


@query("ingest_mixed_folder", f"""WITH {_FOLDER}, per AS (SELECT f, import_id, count(*) FILTER (r IS NULL) AS ok, count(*) FILTER (r <> 'duplicate') AS bad FROM rows_ GROUP BY ALL), q AS (SELECT f, import_id, count(*) AS pending_added FROM unseen GROUP BY ALL)
  SELECT import_id * 10 + f AS import_id, CASE f WHEN 1 THEN 'bp_transaction' WHEN 2 THEN 'mobil' WHEN 3 THEN 'mileage' WHEN 4 THEN 'idle' WHEN 5 THEN 'exec_summary' ELSE 'bp' END AS format, CASE WHEN ok = 0 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN ok = 0 THEN 'No valid records to import' END AS error_message, ok AS records_upserted, bad AS rows_skipped, coalesce(pending_added, 0) AS pending_added, NULL AS detected_category, NULL AS detected_headers
  FROM per LEFT JOIN q USING (f, import_id) UNION ALL SELECT n_nationkey * 10 + 6, 'unknown', 'unrecognized', NULL, NULL, NULL, NULL, 'unknown', concat(n_name, ',x') FROM nation""")  # fmt: skip
def _(f: Fleet):
    """Status of every file of a folder of all formats, taken in at once; unseen cards become assets first."""
    return ingest_files(*_folder(f)).status


_KEPT_EXEC = "SELECT source_id AS asset_id, record_date, total_minutes, coalesce(idle_minutes, 0) AS idle, distance FROM exec_rows WHERE vehicle_name <> '' AND total_minutes <> 0"


@query("ingest_mixed_telematics", f"""WITH ex AS MATERIALIZED ({_KEPT_EXEC}), idl AS MATERIALIZED (SELECT asset_id, record_date, sum(duration) / 60 AS h FROM idle_rows WHERE duration IS NOT NULL AND lower(trim(unit)) IN ('', 'min') AND asset_id % 13 <> 0 GROUP BY ALL HAVING sum(duration) > 0 AND sum(duration) / 60 <= 24),
  own AS MATERIALIZED (SELECT asset_id, current_odometer AS own FROM assets), t AS MATERIALIZED ({_TARGET}), last_t AS MATERIALIZED (SELECT asset_id, max(record_date) AS d, max_by(odometer_km, record_date) AS v, max_by(odometer_km, record_date) FILTER (odometer_km <> 0) AS nz FROM t WHERE odometer_km IS NOT NULL GROUP BY ALL),
  mil AS MATERIALIZED (SELECT m.asset_id, m.record_date, coalesce(nz, own, 0e0) + sum(distance) OVER (PARTITION BY m.asset_id ORDER BY first_pos ROWS UNBOUNDED PRECEDING) AS odo FROM ({MILEAGE}) m LEFT JOIN last_t USING (asset_id) LEFT JOIN own USING (asset_id) WHERE m.asset_id % 13 <> 0),
  last_m AS MATERIALIZED (SELECT asset_id, max(record_date) AS d, max_by(odo, record_date) AS v FROM mil GROUP BY ALL),
  base AS MATERIALIZED (SELECT o.asset_id, own, greatest(x.d, y.d) AS d, CASE WHEN y.d IS NOT NULL AND (x.d IS NULL OR y.d >= x.d) THEN y.v ELSE x.v END AS v FROM own o LEFT JOIN last_t x USING (asset_id) LEFT JOIN last_m y USING (asset_id)),
  ex_odo AS MATERIALIZED (SELECT e.asset_id, e.record_date, CASE WHEN distance > 0 THEN coalesce(v, own) + distance * (1 + count(*) FILTER (d IS NULL OR e.record_date >= d) OVER (PARTITION BY e.asset_id ORDER BY e.record_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS odo FROM ex e JOIN base USING (asset_id))
  SELECT asset_id, record_date, CASE WHEN ex.asset_id IS NOT NULL THEN (total_minutes - idle) / 60 ELSE t.operating_hours END AS operating_hours, CASE WHEN ex.asset_id IS NOT NULL THEN idle / 60 WHEN idl.asset_id IS NOT NULL THEN idl.h ELSE t.idle_hours END AS idle_hours,
    CASE WHEN ex.asset_id IS NOT NULL THEN total_minutes / 60 ELSE t.total_engine_hours END AS total_engine_hours, CASE WHEN ex.asset_id IS NOT NULL THEN ex_odo.odo WHEN mil.asset_id IS NOT NULL THEN mil.odo ELSE t.odometer_km END AS odometer_km, CASE WHEN mil.asset_id IS NOT NULL OR ex.asset_id IS NOT NULL THEN NULL ELSE t.litres_consumed END AS litres_consumed
  FROM t FULL JOIN ex USING (asset_id, record_date) FULL JOIN idl USING (asset_id, record_date) FULL JOIN mil USING (asset_id, record_date) LEFT JOIN ex_odo USING (asset_id, record_date)""", "operating_hours idle_hours total_engine_hours odometer_km litres_consumed")  # fmt: skip
def _(f: Fleet):
    """The telematics table after the same folder: the last file counts for each cell, odometers of both feeds run on from each other."""
    return ingest_files(*_folder(f)).telematics.select("asset_id", "record_date", "operating_hours", "idle_hours", "total_engine_hours", "odometer_km", "litres_consumed")


def _vehicle():
    """The number of an asset there was, or 'new' and the card of one that the folder made."""
    new = F.coalesce(F.concat(F.lit("new "), F.col("bp_card_number")), F.concat(F.lit("new mobil "), F.col("mobil_card_number")))
    return F.when(F.col("asset_id") < MADE, F.col("asset_id").cast("string")).otherwise(new).alias("vehicle")


@query("ingest_mixed_fuel", f"""WITH {_FOLDER} SELECT user_id, k AS vehicle, purchase_date, litres, c2 AS cost_nzd, CASE f WHEN 1 THEN 'bp-transaction' WHEN 2 THEN 'mobil' ELSE 'BP CSV' END AS source FROM jr WHERE r2 IS NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, k, purchase_date, litres ORDER BY f % 7 DESC, import_id DESC, n DESC) = 1""", "litres cost_nzd")  # fmt: skip
def _(f: Fleet):
    """The purchases after the same folder: of the same asset, day and litres the last file's."""
    got = ingest_files(*_folder(f))
    names = got.assets.select(F.col("asset_id").alias("vehicle_id"), _vehicle())
    return got.fuel.join(names, "vehicle_id").select("user_id", "vehicle", "purchase_date", "litres", "cost_nzd", "source")


@query("ingest_mixed_assets", f"""WITH {_FOLDER}, new_mobil AS (SELECT m.user_id, mc AS card, CASE WHEN arg_min(description, (import_id, n)) LIKE 'T%' THEN arg_min(description, (import_id, n)) ELSE concat('Card ••••', right(mc, 4)) END AS name, arg_min(p, (import_id, n)) FILTER (p NOT IN ('Shop', 'Car Wash')) AS fuel, arg_min(import_id, (import_id, n)) FILTER (p NOT IN ('Shop', 'Car Wash')) = min(import_id) AS own_file
    FROM mr m LEFT JOIN km ON km.user_id = m.user_id AND km.card = m.mc WHERE m.card NOT IN ('', 'null') AND km.k IS NULL GROUP BY m.user_id, mc)
  SELECT user_id, cast(asset_id AS varchar) AS vehicle, concat('V', cast(asset_id AS varchar)) AS asset_name, fuel_type FROM va UNION ALL SELECT user_id, concat('new ', card), name, 'Diesel' FROM st UNION ALL SELECT user_id, concat('new mobil ', card), name, CASE WHEN own_file AND fuel = 'Unleaded 91' THEN 'Petrol' ELSE 'Diesel' END FROM new_mobil""")  # fmt: skip
def _(f: Fleet):
    """The assets after the same folder: those there were and one for each unseen card."""
    got = ingest_files(*_folder(f)).assets
    return got.select("user_id", _vehicle(), "asset_name", "fuel_type")


@query("ingest_mixed_pending", f"WITH {_FOLDER} SELECT import_id * 10 + f AS import_id, user_id, asset_name, source FROM unseen QUALIFY row_number() OVER (PARTITION BY user_id, asset_name ORDER BY came, import_id, n) = 1")
def _(f: Fleet):
    """Names and plain cards that wait for review after the same folder: each as the first file had it."""
    return ingest_files(*_folder(f)).pending.select("import_id", "user_id", "asset_name", "source")


@query("ingest_mixed_rejects", f"WITH {_FOLDER} SELECT import_id * 10 + f AS import_id, r AS reject_reason, count(*) AS n_rows FROM rows_ WHERE r IS NOT NULL AND r <> 'duplicate' GROUP BY ALL")
def _(f: Fleet):
    return ingest_files(*_folder(f)).rejects


_NAME = "trim(CASE WHEN description <> '' THEN description WHEN registration <> '' THEN registration WHEN driver <> '' THEN driver ELSE card END)"
_HINT = f"trim(CASE WHEN description <> '' THEN description WHEN registration <> '' THEN registration WHEN driver <> '' THEN driver ELSE {_NAME} END)"
_BEST = f"""best AS (SELECT import_id, user_id, card, {_NAME} AS asset_name, {_HINT} AS type_hint, CASE WHEN description <> '' THEN 4 WHEN registration <> '' THEN 3 WHEN driver <> '' THEN 2 ELSE 1 END AS name_rank FROM cr WHERE card <> ''
  QUALIFY row_number() OVER (PARTITION BY import_id, user_id, card ORDER BY name_rank DESC, n) = 1)"""
#: Card rows whose names may be assets: some descriptions are asset names in another case.
_CR = "SELECT import_id, user_id, n, card, purchase_date, litres, cost, product, CASE WHEN n % 6 = 0 THEN concat('HILUX UTE ', cast(n % 150 AS string)) ELSE description END AS description, registration, driver FROM card_rows"


def _cr(f: Fleet):
    return f.spark.sql(_CR.replace("FROM card_rows", "FROM {card_rows}"), card_rows=f.card_rows).withColumnRenamed("n", "pos")


@query("best_card_detail", f"WITH cr AS ({_CR}), {_BEST} SELECT * FROM best")
def _(f: Fleet):
    return resolve.best_card_detail(_cr(f))


_THREE = f"""nm AS (SELECT concat(user_id, '|', lower(trim(asset_name))) AS k, max(asset_id) AS id FROM assets GROUP BY ALL), bn AS (SELECT * FROM nm WHERE k NOT IN (SELECT concat(user_id, '|', lower(trim(asset_name))) FROM ignored)), bc AS (SELECT concat(user_id, '|', bp_card_number) AS k, max(asset_id) AS id FROM assets GROUP BY ALL),
  own AS (SELECT *, lower({_NAME}) AS own_nm, CASE WHEN description <> '' THEN 4 WHEN registration <> '' THEN 3 WHEN driver <> '' THEN 2 ELSE 1 END AS name_rank FROM ({_CR}) c),
  cr AS (SELECT *, first_value(own_nm) OVER (PARTITION BY import_id, user_id, card ORDER BY name_rank DESC, n) AS best_nm FROM own),
  three AS (SELECT cr.*, CASE WHEN card <> '' THEN coalesce(bc.id, bn.id, nm.id) END AS asset_id FROM cr LEFT JOIN bc ON bc.k = concat(user_id, '|', card) LEFT JOIN bn ON bn.k = concat(user_id, '|', best_nm) LEFT JOIN nm ON nm.k = concat(user_id, '|', own_nm))"""


@query("join_assets_card_then_name", f"WITH {_THREE} SELECT import_id, n AS pos, asset_id FROM three")
def _(f: Fleet):
    return resolve.join_card_then_name(_cr(f), f.assets, f.ignored).select("import_id", "pos", "asset_id")


@query("clean_bp", f"WITH {_THREE} SELECT import_id, n AS pos, CASE WHEN card = '' THEN 'no_card' WHEN asset_id IS NULL THEN 'no_asset' WHEN NOT {_FUEL} THEN 'not_fuel' WHEN cost IS NOT NULL AND litres > 0 AND (cost / litres < 0.5e0 OR cost / litres > 6) THEN 'price_out_of_band' END AS reject_reason FROM three")
def _(f: Fleet):
    return resolve.clean_bp(resolve.join_card_then_name(_cr(f), f.assets, f.ignored)).select("import_id", "pos", "reject_reason")


_NEW = "SELECT n.* FROM named_rows n WHERE vehicle_name <> '' AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.user_id = n.user_id AND a.asset_name = n.vehicle_name) AND NOT EXISTS (SELECT 1 FROM ignored g WHERE g.user_id = n.user_id AND g.asset_name = n.vehicle_name)"


@query("new_pending_assets", f"SELECT user_id, vehicle_name AS asset_name, nullif(arg_min(registration, import_id * 100000 + pos), '') AS registration, CASE WHEN vehicle_name LIKE 'Exc%' THEN 'Excavator' WHEN vehicle_name LIKE 'Hino%' THEN 'Rigid Truck' WHEN vehicle_name LIKE 'Hilux%' THEN 'Light Vehicle' ELSE 'Bulldozer' END AS asset_type, min(import_id) AS import_id FROM ({_NEW}) x GROUP BY user_id, vehicle_name")
def _(f: Fleet):
    rows = f.named_rows.withColumn("rec", F.create_map(F.lit("VehicleName"), "vehicle_name"))
    return resolve.new_pending_assets(rows, f.assets, f.ignored, "exec").select("user_id", "asset_name", "registration", "asset_type", "import_id")


@query("new_pending_bp", f"""WITH cr AS ({_CR}), {_BEST} SELECT import_id, user_id, asset_name, concat('{{"cardNumber":"', card, '","typeHint":"', replace(type_hint, '"', '\\"'), '"}}') AS raw_data FROM best b WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.user_id = b.user_id AND a.bp_card_number = b.card)
  AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.user_id = b.user_id AND lower(a.asset_name) = lower(b.asset_name)) AND NOT EXISTS (SELECT 1 FROM ignored g WHERE g.user_id = b.user_id AND lower(g.asset_name) = lower(b.asset_name))""")  # fmt: skip
def _(f: Fleet):
    return resolve.new_pending_bp(_cr(f), f.assets, f.ignored).select("import_id", "user_id", "asset_name", "raw_data")


@query("new_stub_assets", """WITH o AS (SELECT * FROM card_rows WHERE card NOT IN ('', 'null') AND card NOT IN (SELECT bp_card_number FROM assets) QUALIFY row_number() OVER (PARTITION BY card ORDER BY import_id, n) = 1)
  SELECT user_id, card, CASE WHEN description NOT IN ('', 'JOHN SMITH') THEN trim(description) WHEN driver NOT IN ('', 'Mary Jones') THEN driver ELSE concat('Card ••••', right(card, 4)) END AS asset_name, 'Diesel' AS fuel_type FROM o""")  # fmt: skip
def _(f: Fleet):
    return resolve.new_stub_assets_bp(_card_records(f), f.assets).select("user_id", F.col("bp_card_number").alias("card"), "asset_name", "fuel_type")


@query("new_stub_assets_mobil", f"""WITH m AS (SELECT *, regexp_replace(card, '^BP', 'MB') AS mc, {_MOBIL} AS p FROM card_rows WHERE card NOT IN ('', 'null')), o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.user_id = m.user_id AND a.mobil_card_number = m.mc))
  SELECT user_id, mc AS card, CASE WHEN arg_min(description, (import_id, n)) LIKE 'T%' THEN arg_min(description, (import_id, n)) ELSE concat('Card ••••', right(mc, 4)) END AS asset_name,
    CASE WHEN arg_min(p, (import_id, n)) FILTER (p NOT IN ('Shop', 'Car Wash')) = 'Unleaded 91' AND arg_min(import_id, (import_id, n)) FILTER (p NOT IN ('Shop', 'Car Wash')) = min(import_id) THEN 'Petrol' ELSE 'Diesel' END AS fuel_type FROM o GROUP BY user_id, mc""")  # fmt: skip
def _(f: Fleet):
    return resolve.new_stub_assets_mobil(_mobil(f), f.assets).select("user_id", F.col("mobil_card_number").alias("card"), "asset_name", "fuel_type")


@query("import_status", f"""WITH {_CLEAN}, i AS (SELECT DISTINCT import_id + 1000000 * k AS import_id, CASE WHEN k = 2 THEN 'unknown' ELSE 'bp_transaction' END AS format FROM card_rows, (VALUES (0), (1), (2)) v(k)),
  p AS (SELECT import_id, count(*) FILTER (reject_reason IS NULL) AS valid FROM c3 GROUP BY import_id)
  SELECT import_id, format, CASE WHEN format = 'unknown' THEN 'unrecognized' WHEN coalesce(valid, 0) = 0 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN format = 'unknown' THEN NULL WHEN valid IS NULL THEN 'No rows found' WHEN valid = 0 THEN 'No valid records to import' END AS error_message FROM i LEFT JOIN p USING (import_id)""")  # fmt: skip
def _(f: Fleet):
    kinds = F.explode(F.array(*map(F.lit, range(3))))
    imports = f.card_rows.select(F.col("import_id").alias("own")).distinct().select("own", kinds.alias("k")).select((F.col("own") + 1_000_000 * F.col("k")).alias("import_id"), F.when(F.col("k") == 2, "unknown").otherwise("bp_transaction").alias("format"))
    return U.import_status(imports, _cleaned(f).select("import_id", "reject_reason"))


@query("import_summary", f"WITH {_CLEAN}, p AS (SELECT import_id, count(*) AS pending_added FROM (SELECT user_id, vehicle_name, min(import_id) AS import_id FROM ({_NEW}) x GROUP BY ALL) y GROUP BY import_id) SELECT import_id, count(*) FILTER (reject_reason IS NULL) AS records_upserted, count(*) FILTER (reject_reason IS NOT NULL AND reject_reason <> 'duplicate') AS rows_skipped, coalesce(any_value(pending_added), 0) AS pending_added FROM c3 LEFT JOIN p USING (import_id) GROUP BY import_id")
def _(f: Fleet):
    rows = f.named_rows.withColumn("rec", F.create_map(F.lit("VehicleName"), "vehicle_name"))
    return U.import_summary(_cleaned(f).select("import_id", "reject_reason"), resolve.new_pending_assets(rows, f.assets, f.ignored, "exec"))


@query("reject_counts", f"WITH {_CLEAN} SELECT import_id, reject_reason, count(*) AS n_rows FROM c3 WHERE reject_reason IS NOT NULL AND reject_reason <> 'duplicate' GROUP BY ALL")
def _(f: Fleet):
    return U.reject_counts(_cleaned(f))


_V_ASSETS = f"SELECT asset_id, user_id, {_FEED} AS asset_name, current_odometer FROM assets WHERE asset_id % 13 <> 0"
_RUN = f"""SELECT m.asset_id, m.record_date, coalesce(a.current_odometer, 0e0) + sum(distance) OVER (PARTITION BY m.asset_id ORDER BY first_pos ROWS UNBOUNDED PRECEDING) AS odometer_km
  FROM ({MILEAGE}) m JOIN assets a ON a.asset_id = m.asset_id WHERE m.asset_id % 13 <> 0"""


@query("stream_ingest", f"SELECT * FROM ({_RUN}) r", "odometer_km")
def _(f: Fleet):
    """Mileage files arrive in a folder and become the telematics table, in two batches, half of the files each."""
    path = f.scratch()
    _delivered(f.mileage_files(), f"{path}/in")
    spark, assets = f.spark, f.sql(_V_ASSETS)

    def account(df):
        return df.join(assets.select("user_id", F.col("asset_name").alias("_v")), F.col("_v") == F.regexp_extract("raw_csv", r"(?m)^(V\d+),", 1)).drop("_v")

    n = f.mileage_rows.select("asset_id").distinct().count()
    files = jobs.read_file_stream(spark, f"{path}/in/*", -(-n // 2)).withColumn("filename", F.concat("filename", F.md5("raw_csv")))
    store = jobs.fleet_store(spark, f"{path}/tables", assets)
    jobs.stream_ingest(files, store, account, f"{path}/state").awaitTermination()
    return store.read("telematics", store.manifest()).select("asset_id", "record_date", "odometer_km")


@query("stream_running_odometer", f"SELECT m.asset_id, record_date, coalesce(a.current_odometer, 0e0) + sum(distance) OVER (PARTITION BY m.asset_id ORDER BY import_id, first_pos ROWS UNBOUNDED PRECEDING) AS odometer_km FROM ({MILEAGE}) m LEFT JOIN assets a USING (asset_id)", "odometer_km")
def _(f: Fleet):
    """The stateful form, over daily mileage written as files and read as a stream."""
    path, spark = f.scratch(), f.spark
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    daily = T.daily_mileage(f.mileage_rows).join(f.assets.select("asset_id", F.col("current_odometer").alias("base")), "asset_id", "left").withColumn("received_at", F.col("import_id"))
    daily.select("asset_id", "record_date", "distance", "base", "received_at", "import_id", "first_pos").write.parquet(f"{path}/in")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("asset_id long, record_date date, distance double, base double, received_at long, import_id long, first_pos long").parquet(f"{path}/in")
        out = jobs.stream_running_odometer(stream)
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, old)
    return spark.read.schema("asset_id long, record_date date, odometer_km double").parquet(f"{path}/out")
