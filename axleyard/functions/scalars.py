"""Column functions: parsing, classifying and formatting single values. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

#: White space that String.trim() of the feeds' origin removes; Spark's trim() only removes blanks.
_WHITE = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER_PREFIX = rf"^[{_WHITE}]*+([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE))


def _prefix(c: Column) -> Column:
    # an empty text is cast to null by way of an exception
    return F.when(c != "", F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double"))


def parse_numeric(c: Column) -> Column:
    """Commas go, then the leading number behind white space; null where there is none."""
    return _prefix(F.replace(c, F.lit(",")))


def parse_currency(c: Column) -> Column:
    """As parse_numeric, and every $ goes."""
    return _prefix(F.replace(F.replace(c, F.lit(",")), F.lit("$")))


def safe_num(c: Column) -> Column:
    """A double column without NaN."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def parse_dmy(c: Column) -> Column:
    """D/M/YYYY, day first; days that no calendar has are null."""
    t = js_trim(c)
    # a cast reads bytes, which takes a fraction of a formatter's time
    iso = F.concat_ws("-", F.right(t, F.lit(4)), F.substring_index(F.substring_index(t, "/", 2), "/", -1), F.substring_index(t, "/", 1))
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), iso.try_cast("date"))


def parse_dmy_datetime(c: Column) -> Column:
    """The day of D/M/YYYY HH:MM."""
    return parse_dmy(F.get(F.split(js_trim(c), " "), F.lit(0)))


def record_date_from_filename(filename: Column, received_at: Column) -> Column:
    """A day in the file's name (year first, else day first), else the day it was received, else today."""
    iso = F.regexp_extract(filename, r"(\d{4})[-_](\d{2})[-_](\d{2})", 0)
    dmy = F.regexp_extract(filename, r"(\d{2})[-_](\d{2})[-_](\d{4})", 0)
    day = lambda text, form: F.try_to_date(F.regexp_replace(F.nullif(text, F.lit("")), "_", "-"), form)
    return F.when(F.coalesce(iso, F.lit("")) != "", day(iso, "yyyy-MM-dd")).when(F.coalesce(dmy, F.lit("")) != "", day(dmy, "dd-MM-yyyy")).otherwise(F.coalesce(F.to_date(received_at), F.current_date()))


def _any_of(c: Column, words: list[str]) -> Column:
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def detect_asset_type(name: Column) -> Column:
    """Ordered substring rules; trucks are the default."""
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(_any_of(n, S.SEMI_WORDS), "Semi Trailer").when(_any_of(n, S.TRUCK_WORDS), "Rigid Truck")
    out = out.when(_any_of(n, S.LIGHT_WORDS) | n.rlike(r"\bcar\b"), "Light Vehicle")
    for kind, words in S.MACHINE_WORDS:
        out = out.when(_any_of(n, words), kind)
    return out.otherwise("Rigid Truck")


def idle_class(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.rlike("crane|bucket"), "pto_heavy").when(n.rlike(r"\bute\b|ranger|hilux|navara|triton|honda|civic|corolla"), "light_vehicle").otherwise("standard_truck")


def bp_fuel_product(product: Column) -> Column:
    return F.coalesce(js_trim(product).isin(S.BP_FUEL_PRODUCTS), F.lit(False))


def mobil_fuel_product(product: Column) -> Column:
    return F.coalesce(js_trim(product).isin(S.MOBIL_FUEL_PRODUCTS), F.lit(False))


def mobil_fuel_type(product: Column) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(product, F.lit(""))), F.lit("diesel")), "Diesel").otherwise("Petrol")


def card(c: Column) -> Column:
    return js_trim(F.coalesce(c, F.lit("")))


def valid_card(c: Column) -> Column:
    return (card(c) != "") & ~F.lower(card(c)).isin("null", "undefined")


def person_name_like(c: Column) -> Column:
    return c.rlike(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)+$") | c.rlike(r"^[A-Z]+(\s+[A-Z]+)+$")


def vehicle_code_like(c: Column) -> Column:
    t = js_trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~person_name_like(t)


def mobil_code_like(c: Column) -> Column:
    return F.regexp_replace(js_trim(F.coalesce(c, F.lit(""))), r"\s+", "").rlike(r"^[A-Za-z]{1,4}\d{1,4}[A-Za-z]?$")


def stub_asset_name_bp(description: Column, driver: Column, card_number: Column) -> Column:
    d, r = (js_trim(F.coalesce(c, F.lit(""))) for c in (description, driver))
    return F.when(vehicle_code_like(d), d).when(vehicle_code_like(r), r).otherwise(F.concat(F.lit("Card ••••"), F.right(card(card_number), F.lit(4))))


def stub_asset_name_mobil(description: Column, card_number: Column) -> Column:
    d = js_trim(F.coalesce(description, F.lit("")))
    return F.when(mobil_code_like(d), d).otherwise(F.concat(F.lit("Card ••••"), F.right(card(card_number), F.lit(4))))


def _filled(c: Column) -> Column:
    return F.nullif(js_trim(F.coalesce(c, F.lit(""))), F.lit(""))


def bp_asset_name(description: Column, registration: Column, driver: Column, card_number: Column) -> Column:
    return F.coalesce(_filled(description), _filled(registration), _filled(driver), card(card_number))


def bp_name_rank(description: Column, registration: Column, driver: Column) -> Column:
    return F.when(_filled(description).isNotNull(), 4).when(_filled(registration).isNotNull(), 3).when(_filled(driver).isNotNull(), 2).otherwise(1)


def bp_type_hint(description: Column, registration: Column, driver: Column, name: Column) -> Column:
    return F.coalesce(_filled(description), _filled(registration), _filled(driver), name)


def email_address(raw: Column) -> Column:
    t = js_trim(F.coalesce(raw, F.lit("")))
    inner = F.regexp_extract(t, "<([^>]+)>", 1)
    return F.lower(js_trim(F.when(inner != "", inner).otherwise(t)))


def email_local_part(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def recipient(to: Column, envelope: Column) -> Column:
    """The address mailed to; where that is empty, the first one of the JSON envelope."""
    return email_address(F.coalesce(_filled(to), F.get_json_object(envelope, "$.to[0]")))


def slugify(name: Column) -> Column:
    s = js_trim(F.lower(F.coalesce(name, F.lit(""))))
    for pattern, put in ((r"\s+", "-"), ("[^a-z0-9-]", ""), ("-+", "-"), ("^-+|-+$", "")):
        s = F.regexp_replace(s, pattern, put)
    return s


def file_slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?i)[^a-z0-9-_]+", "-"))


def is_on_road(flag: Column, asset_type: Column) -> Column:
    return F.coalesce(flag, js_trim(asset_type).isin(S.ON_ROAD_TYPES), F.lit(False))


def _lookup(table: dict[str, float], key: Column, other: float) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def emission_factor(fuel_type: Column) -> Column:
    return _lookup(S.EMISSION_FACTORS, fuel_type, S.OTHER_EMISSION_FACTOR)


def default_idle_rate(rate: Column, asset_type: Column) -> Column:
    """The asset's own rate unless missing or zero, else that of its type."""
    return F.coalesce(F.nullif(rate, F.lit(0.0)), _lookup(S.DEFAULT_IDLE_RATES, asset_type, S.OTHER_IDLE_RATE))


def calendar_days(start: Column, end: Column) -> Column:
    return F.greatest(F.datediff(end, start) + 1, F.lit(1))


def working_days(start: Column, end: Column) -> Column:
    """Monday to Friday days of an inclusive range, at least 1, without listing the days."""
    days = F.datediff(end, start) + 1
    first = F.weekday(start)
    # full weeks have 5; of the rest, those before the week's end and after the next Monday
    rest = days % 7
    last = first + rest
    part = F.greatest(F.least(last, F.lit(5)) - F.least(first, F.lit(5)), F.lit(0)) + F.greatest(last - 7, F.lit(0))
    return F.greatest(F.when(days > 0, F.floor(days / 7) * 5 + part).otherwise(0), F.lit(1)).cast("long")


def missing_message(missing: Column) -> Column:
    return F.concat(F.lit("Cannot calculate — missing: "), F.array_join(missing, ", "))


def cost_or_missing(value: Column, missing: Column, exceeded: Column, near: Column) -> Column:
    """A cost as text, or why there is none."""
    return (
        F.when(exceeded & near, S.LIFE_NEAR_LIMIT_MESSAGE)
        .when(exceeded, S.LIFE_EXCEEDED_MESSAGE)
        .when(F.size(missing) > 0, missing_message(missing))
        .when(value.isNull(), "—")
        .otherwise(F.format_string("%.2f", value))
    )
