"""Queries of the column functions: texts are made from the tables' numbers, so the SQL side knows each answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from .base import query
from .fixtures import Fleet

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_Q = "cast(cast(l_quantity AS int) AS string)"
_NUMBER_TEXTS = f"""SELECT {_LINE}, CASE l_partkey % 8 WHEN 0 THEN concat(' ', {_Q}, ' ') WHEN 1 THEN concat('$', {_Q}) WHEN 2 THEN concat({_Q}, 'abc') WHEN 3 THEN concat('1,', cast(100 + l_partkey % 900 AS string))
  WHEN 4 THEN '' WHEN 5 THEN concat('-', {_Q}, '.5') WHEN 6 THEN concat({_Q}, 'e2') ELSE concat({_Q}, ' 7') END AS v FROM {{lineitem}}"""
_NUMBERS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 8 WHEN 0 THEN l_quantity WHEN 1 THEN {dollar} WHEN 2 THEN l_quantity WHEN 3 THEN 1000e0 + 100 + l_partkey % 900
  WHEN 4 THEN NULL WHEN 5 THEN -(l_quantity + 0.5e0) WHEN 6 THEN l_quantity * 100e0 ELSE l_quantity END AS n FROM lineitem"""


@query("parse_numeric", _NUMBERS.format(dollar="NULL"), "n")
def _(f: Fleet):
    return f.sql(_NUMBER_TEXTS).select(*_LINE.split(", "), X.parse_numeric(F.col("v")).alias("n"))


@query("parse_currency", _NUMBERS.format(dollar="l_quantity"), "n")
def _(f: Fleet):
    return f.sql(_NUMBER_TEXTS).select(*_LINE.split(", "), X.parse_currency(F.col("v")).alias("n"))


@query("safe_num", "SELECT event_id, value / CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1e0 END AS n FROM events", "n")
def _(f: Fleet):
    return f.table("events").select("event_id", X.safe_num(F.when(F.col("event_id") % 3 == 0, F.lit("NaN").cast("double")).otherwise(F.col("value"))).alias("n"))


def _dmy_text(f: Fleet):
    d = F.col("o_orderdate")
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN 1 THEN date_format(o_orderdate, ' dd/MM/yyyy ') WHEN 2 THEN concat('31/02/', cast(year(o_orderdate) AS string)) WHEN 3 THEN date_format(o_orderdate, 'd/M/yy') ELSE date_format(o_orderdate, 'd/M/yyyy') END")
    return f.table("orders").select("o_orderkey", text.alias("v"), d.alias("d"))


@query("parse_dmy", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE cast(o_orderdate AS date) END AS day FROM orders")
def _(f: Fleet):
    return _dmy_text(f).select("o_orderkey", X.parse_dmy(F.col("v")).alias("day"))


@query("parse_dmy_datetime", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(ts AS date) END AS day FROM events")
def _(f: Fleet):
    text = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm"))
    return f.table("events").select("event_id", X.parse_dmy_datetime(text).alias("day"))


@query("record_date_from_filename", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN cast(o_orderdate AS date) + 7 ELSE cast(o_orderdate AS date) END AS day FROM orders")
def _(f: Fleet):
    o = f.table("orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("report_"), F.date_format("o_orderdate", "yyyy-MM_dd"), F.lit(".csv"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "dd_MM-yyyy"), F.lit(" idle.csv"))).otherwise("latest.csv")
    return o.select("o_orderkey", X.record_date_from_filename(name, F.date_add(F.to_date("o_orderdate"), 7)).alias("day"))


_NAMES = "CASE p_partkey % 16 WHEN 0 THEN 'Kenworth T9 ' WHEN 1 THEN 'UD Truck ' WHEN 2 THEN 'Ford Ranger ' WHEN 3 THEN 'Company car ' WHEN 4 THEN 'Card ' WHEN 5 THEN 'CAT dozer ' WHEN 6 THEN 'Digger ' WHEN 7 THEN 'Grader ' WHEN 8 THEN 'Forklift ' WHEN 9 THEN 'Crane ' WHEN 10 THEN 'Loader ' WHEN 11 THEN 'Roller ' WHEN 12 THEN 'Route ' WHEN 13 THEN 'Advance ' WHEN 14 THEN 'Honda ute ' ELSE 'Bucket ' END"


@query("detect_asset_type", """SELECT p_partkey, CASE p_partkey % 16 WHEN 0 THEN 'Semi Trailer' WHEN 1 THEN 'Rigid Truck' WHEN 2 THEN 'Light Vehicle' WHEN 3 THEN 'Light Vehicle' WHEN 4 THEN 'Rigid Truck' WHEN 5 THEN 'Bulldozer' WHEN 6 THEN 'Excavator' WHEN 7 THEN 'Motor Grader'
  WHEN 8 THEN 'Forklift' WHEN 9 THEN 'Crane' WHEN 10 THEN 'Wheel Loader' WHEN 11 THEN 'Other' WHEN 12 THEN 'Light Vehicle' WHEN 13 THEN 'Light Vehicle' WHEN 14 THEN 'Light Vehicle' ELSE 'Rigid Truck' END AS kind FROM part""")  # fmt: skip
def _(f: Fleet):
    return f.table("part").select("p_partkey", X.detect_asset_type(F.concat(F.expr(_NAMES), F.col("p_partkey").cast("string"))).alias("kind"))


@query("idle_class", "SELECT p_partkey, CASE WHEN p_partkey % 16 IN (9, 15) THEN 'pto_heavy' WHEN p_partkey % 16 IN (2, 14) THEN 'light_vehicle' ELSE 'standard_truck' END AS kind FROM part")
def _(f: Fleet):
    return f.table("part").select("p_partkey", X.idle_class(F.concat(F.expr(_NAMES), F.col("p_partkey").cast("string"))).alias("kind"))


@query("fuel_product_known", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber NOT IN (4, 6) AS bp, l_linenumber IN (1, 3) AS mobil FROM lineitem")
def _(f: Fleet):
    names = F.array(*(F.lit(x) for x in ("Diesel", "NZ Diesel", "Synergy Diesel\\Extra Diesel", "Shop", "x", "Lubricants", "nz diesel")))
    bp = F.array(*(F.lit(x) for x in (*(" NZ Diesel ", "NZ Ultimate", "NZ Unleaded"), "NZ AdBlue", "NZ Premium Unleaded", "NZ Carwash", "NZ Ultimate Diesel")))
    i = F.col("l_linenumber") - 1
    return f.table("lineitem").select(*_LINE.split(", "), X.bp_fuel_product(F.get(bp, i)).alias("bp"), X.mobil_fuel_product(F.get(names, i)).alias("mobil"))


@query("mobil_fuel_type", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'Diesel' ELSE 'Petrol' END AS kind FROM lineitem")
def _(f: Fleet):
    return f.table("lineitem").select(*_LINE.split(", "), X.mobil_fuel_type(F.when(F.col("l_linenumber") % 2 == 0, "Mobil DIESEL Efficient").when(F.col("l_linenumber") == 1, "Unleaded 91")).alias("kind"))


@query("valid_card", "SELECT import_id, n, card NOT IN ('', 'null') AS ok FROM card_rows")
def _(f: Fleet):
    return f.card_rows.select("import_id", "n", X.valid_card(F.when(F.col("card") == "null", " NULL ").otherwise(F.col("card"))).alias("ok"))


@query("person_name_like", "SELECT import_id, n, description = 'JOHN SMITH' AS person, description NOT IN ('', 'JOHN SMITH') AS vehicle, driver = 'Mary Jones' AS driver_person FROM card_rows")
def _(f: Fleet):
    return f.card_rows.select("import_id", "n", X.person_name_like(F.col("description")).alias("person"), X.vehicle_code_like(F.col("description")).alias("vehicle"), X.person_name_like(F.col("driver")).alias("driver_person"))


@query("mobil_code_like", "SELECT import_id, n, description LIKE 'T%' AS code FROM card_rows")
def _(f: Fleet):
    return f.card_rows.select("import_id", "n", X.mobil_code_like(F.regexp_replace("description", "^T", " T ")).alias("code"))


@query("stub_asset_name", """SELECT import_id, n, CASE WHEN description NOT IN ('', 'JOHN SMITH') THEN description WHEN driver NOT IN ('', 'Mary Jones') THEN driver ELSE concat('Card ••••', right(card, 4)) END AS bp,
  CASE WHEN description LIKE 'T%' THEN description ELSE concat('Card ••••', right(card, 4)) END AS mobil FROM card_rows""")  # fmt: skip
def _(f: Fleet):
    return f.card_rows.select("import_id", "n", X.stub_asset_name_bp(F.col("description"), F.col("driver"), F.col("card")).alias("bp"), X.stub_asset_name_mobil(F.col("description"), F.col("card")).alias("mobil"))


@query("bp_asset_name", """SELECT import_id, n, trim(CASE WHEN description <> '' THEN description WHEN registration <> '' THEN registration WHEN driver <> '' THEN driver ELSE card END) AS name,
  CASE WHEN description <> '' THEN 4 WHEN registration <> '' THEN 3 WHEN driver <> '' THEN 2 ELSE 1 END AS name_rank FROM card_rows""")  # fmt: skip
def _(f: Fleet):
    c = [F.col(x) for x in ("description", "registration", "driver")]
    return f.card_rows.select("import_id", "n", X.bp_asset_name(*c, F.col("card")).alias("name"), X.bp_name_rank(*c).alias("name_rank"))


@query("email_parts", """SELECT import_id, lower(trim(replace(replace(replace(to_email, 'Upload ', ''), '<', ''), '>', ''))) AS address, split_part(lower(trim(replace(replace(replace(to_email, 'Upload ', ''), '<', ''), '>', ''))), '@', 1) AS local_part,
  CASE WHEN import_id % 2 = 0 THEN 'first@example.com' ELSE lower(trim(replace(replace(replace(to_email, 'Upload ', ''), '<', ''), '>', ''))) END AS recipient FROM imports""")  # fmt: skip
def _(f: Fleet):
    to = F.when(F.col("import_id") % 2 == 1, F.col("to_email")).otherwise("")
    a = X.email_address(F.col("to_email"))
    return f.imports.select("import_id", a.alias("address"), X.email_local_part(a).alias("local_part"), X.recipient(to, F.lit('{"to": ["First@example.com", "b@example.com"]}')).alias("recipient"))


@query("slugify", "SELECT c_custkey, concat(lower(c_mktsegment), '-customer', lpad(cast(c_custkey AS string), 9, '0'), '-ltd') AS slug, concat('-', lower(c_mktsegment), '-customer-', cast(c_custkey AS string), '-ltd') AS file_slug FROM customer")
def _(f: Fleet):
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    name = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" -  Customer#"), number, F.lit(" & Ltd. - "))
    other = F.concat(F.lit("& "), F.col("c_mktsegment"), F.lit(" Customer#"), F.col("c_custkey").cast("string"), F.lit(".Ltd"))
    return f.table("customer").select("c_custkey", X.slugify(name).alias("slug"), X.file_slug(other).alias("file_slug"))


@query("is_on_road", "SELECT asset_id, coalesce(is_on_road, asset_type IN ('Light Vehicle', 'Rigid Truck', 'Semi Trailer'), false) AS road FROM assets")
def _(f: Fleet):
    return f.assets.select("asset_id", X.is_on_road(F.col("is_on_road"), F.concat(F.lit(" "), F.col("asset_type"))).alias("road"))


FACTOR = "CASE fuel_type WHEN 'Petrol' THEN 2.31e0 WHEN 'Electric' THEN 0e0 WHEN 'Hybrid' THEN 1.5e0 ELSE 2.68e0 END"
IDLE_RATE = "coalesce(nullif(idle_burn_rate_lph, 0e0), CASE asset_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in S.DEFAULT_IDLE_RATES.items()) + " ELSE 3e0 END)"


@query("emission_factor", f"SELECT asset_id, {FACTOR} AS factor FROM assets", "factor")
def _(f: Fleet):
    return f.assets.select("asset_id", X.emission_factor(F.col("fuel_type")).alias("factor"))


@query("default_idle_rate", f"SELECT asset_id, {IDLE_RATE} AS rate FROM assets", "rate")
def _(f: Fleet):
    return f.assets.select("asset_id", X.default_idle_rate(F.col("idle_burn_rate_lph"), F.col("asset_type")).alias("rate"))


_SPAN = "SELECT o_orderkey, cast(o_orderdate AS date) AS a, cast(o_orderdate AS date) + cast(o_custkey % 40 AS int) - 2 AS b FROM {orders}"


@query("calendar_days", "SELECT o_orderkey, greatest(b - a + 1, 1) AS days, greatest(b - a + 1, 1) / 7e0 AS weeks FROM (" + _SPAN.format(orders="orders") + ") x", "weeks")
def _(f: Fleet):
    d = X.calendar_days(F.col("a"), F.col("b"))
    return f.sql(_SPAN).select("o_orderkey", d.alias("days"), (d / 7).alias("weeks"))


@query("working_days", "SELECT o_orderkey, greatest((SELECT count(*) FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d) y WHERE isodow(d) < 6), 1) AS days FROM (" + _SPAN.format(orders="orders") + ") x")
def _(f: Fleet):
    return f.sql(_SPAN).select("o_orderkey", X.working_days(F.col("a"), F.col("b")).alias("days"))


@query("format_message", f"""SELECT asset_id, CASE WHEN asset_id % 5 = 0 THEN '{S.LIFE_NEAR_LIMIT_MESSAGE}' WHEN asset_id % 5 = 1 THEN '{S.LIFE_EXCEEDED_MESSAGE}'
  WHEN current_value IS NULL THEN 'Cannot calculate — missing: Current Value, GVM' WHEN asset_id % 5 = 2 THEN '—' ELSE concat(cast(20000 + 100 * asset_id AS string), '.00') END AS message FROM assets""")  # fmt: skip
def _(f: Fleet):
    k = F.col("asset_id") % 5
    missing = F.when(F.col("current_value").isNull(), F.array(F.lit("Current Value"), F.lit("GVM"))).otherwise(F.array().cast("array<string>"))
    return f.assets.select("asset_id", X.cost_or_missing(F.when(k != 2, F.col("current_value")), missing, k <= 1, k == 0).alias("message"))
