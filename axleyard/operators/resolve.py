"""Which account and asset a row belongs to, and which rows are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..sources.files import record_of


def resolve_account(rows: DataFrame, members: DataFrame, user: str = "user_id") -> DataFrame:
    """``account_id``: the owner of the account the user is a member of, else the user."""
    m = members.groupBy(F.col("member_auth_user_id").alias(user)).agg(F.min("account_owner_user_id").alias("_owner"))
    return rows.join(m, user, "left").withColumn("account_id", F.coalesce("_owner", user)).drop("_owner")


def route_imports(imports: DataFrame, settings: DataFrame) -> DataFrame:
    """Imports with the account whose upload address they were mailed to; others are dropped (see unrouted_imports)."""
    s = settings.select(F.col("user_id").alias("account_id"), F.col("upload_email").alias("_local"))
    return imports.join(s, X.email_local_part(X.email_address(F.col("to_email"))) == F.col("_local")).drop("_local")


def unrouted_imports(imports: DataFrame, settings: DataFrame) -> DataFrame:
    return imports.join(settings, X.email_local_part(X.email_address(F.col("to_email"))) == settings["upload_email"], "left_anti")


def active_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(~F.col("is_ignored"))


def one_per_key(assets: DataFrame, key: Column, name: str) -> DataFrame:
    """(user_id, name, asset_id): of assets that share a key the highest id, so no join multiplies rows."""
    return assets.withColumn(name, key).filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy("user_id", name).agg(F.max("asset_id").alias("asset_id"))


def _matched(rows: DataFrame, assets: DataFrame, key: Column, name: str, out: str = "asset_id", few: bool = False) -> DataFrame:
    """``rows`` with ``out``: the asset of the account whose ``key`` is the row's ``name``.

    Where assets have ``born`` (received_at, import_id), a row meets those alone that its file or an earlier one made.
    ``few``: assets are sent to the rows, which stay where they are.
    """
    if "born" not in assets.columns:
        return rows.join(one_per_key(assets, key, name).withColumnRenamed("asset_id", out), ["user_id", name], "left")
    same = assets.withColumn(name, key).filter(F.col(name) != "").groupBy("user_id", name).agg(F.collect_list(F.struct("born", "asset_id")).alias("_same"))
    known = F.filter("_same", lambda a: a["born"] <= F.struct("received_at", "import_id"))
    return rows.join(F.broadcast(same) if few else same, ["user_id", name], "left").withColumn(out, F.array_max(F.transform(known, lambda a: a["asset_id"]))).drop("_same")


def join_by_name(rows: DataFrame, assets: DataFrame, name: str = "vehicle_name", few: bool = False) -> DataFrame:
    """Exact, case-sensitive name within the account."""
    return _matched(rows, assets, F.col("asset_name"), name, few=few)


def join_by_card(rows: DataFrame, assets: DataFrame, asset_card: str = "bp_card_number", card: str = "card", few: bool = False) -> DataFrame:
    return _matched(rows, assets, X.card(F.col(asset_card)), card, few=few)


def best_card_detail(rows: DataFrame) -> DataFrame:
    """Per (import_id, user_id, card): name and type hint of the row with the highest name rank, the first on ties."""
    d, r, v = F.col("description"), F.col("registration"), F.col("driver")
    name = X.bp_asset_name(d, r, v, F.col("card"))
    ranked = rows.filter(F.col("card") != "").select("import_id", "user_id", "card", F.struct(X.bp_name_rank(d, r, v).alias("rank"), (-F.col("pos")).alias("p"), name.alias("name"), X.bp_type_hint(d, r, v, name).alias("hint")).alias("s"))
    return ranked.groupBy("import_id", "user_id", "card").agg(F.max("s").alias("s")).select("import_id", "user_id", "card", F.col("s.name").alias("asset_name"), F.col("s.hint").alias("type_hint"), F.col("s.rank").alias("name_rank"))


def join_card_then_name(rows: DataFrame, assets: DataFrame, ignored: DataFrame, few: bool = False) -> DataFrame:
    """``asset_id``: by card; else by the card's best name unless that is ignored; else by the row's own name (both in any case)."""
    low = F.lower(X.js_trim(F.col("asset_name")))
    skip = ignored.select("user_id", F.lower(X.js_trim(F.col("asset_name"))).alias("_best"), F.lit(True).alias("_ignored")).distinct()
    best = best_card_detail(rows).select("import_id", "user_id", "card", F.lower("asset_name").alias("_best")).join(skip, ["user_id", "_best"], "left").filter("_ignored is null").drop("_ignored")
    own = rows.withColumn("_name", F.lower(X.bp_asset_name(F.col("description"), F.col("registration"), F.col("driver"), F.col("card"))))
    if "born" in assets.columns:
        named = _matched(own.join(best, ["import_id", "user_id", "card"], "left"), assets, low, "_best", "_by_best", few).drop("_best")
    else:
        best = best.join(one_per_key(assets, low, "_best"), ["user_id", "_best"]).select("import_id", "user_id", "card", F.col("asset_id").alias("_by_best"))
        named = own.join(best, ["import_id", "user_id", "card"], "left")
    j = join_by_card(_matched(named, assets, low, "_name", "_a", few), assets, few=few)
    return j.withColumn("asset_id", F.when(F.col("card") != "", F.coalesce("asset_id", "_by_best", "_a"))).drop("_by_best", "_a", "_name")


def new_pending_assets(rows: DataFrame, assets: DataFrame, ignored: DataFrame, source: str, name: str = "vehicle_name") -> DataFrame:
    """Unseen names of telematics rows that are no asset and not ignored: the first row of each, for review. ``rows`` have ``rec``, ``registration``, ``pos``."""
    rows = rows.filter(F.coalesce(name, F.lit("")) != "")
    fresh = rows.join(assets.select("user_id", F.col("asset_name").alias(name)).distinct(), ["user_id", name], "left_anti")
    fresh = fresh.join(ignored.select("user_id", X.js_trim(F.col("asset_name")).alias(name)).distinct(), ["user_id", name], "left_anti")
    first = fresh.groupBy("user_id", name).agg(F.min_by(F.struct("import_id", "registration", F.to_json("rec").alias("raw")), F.struct("import_id", "pos")).alias("f"))
    n = F.col(name)
    return first.select(F.col("f.import_id").alias("import_id"), "user_id", n.alias("asset_name"), X.detect_asset_type(n).alias("asset_type"), F.nullif("f.registration", F.lit("")).alias("registration"), F.lit(source).alias("source"), F.col("f.raw").alias("raw_data"))


def new_pending_bp(rows: DataFrame, assets: DataFrame, ignored: DataFrame) -> DataFrame:
    """Cards of plain BP rows without an asset, whose best name is neither an asset nor ignored (in any case)."""
    low = lambda df: df.select("user_id", F.lower(X.js_trim(F.col("asset_name"))).alias("_low")).distinct()
    best = best_card_detail(rows).withColumn("_low", F.lower("asset_name"))
    cards = assets.select("user_id", X.card(F.col("bp_card_number")).alias("card")).distinct()
    fresh = best.join(cards, ["user_id", "card"], "left_anti").join(low(assets), ["user_id", "_low"], "left_anti").join(low(ignored), ["user_id", "_low"], "left_anti")
    raw = F.to_json(F.struct(F.col("card").alias("cardNumber"), F.col("type_hint").alias("typeHint")))
    return fresh.select("import_id", "user_id", "asset_name", X.detect_asset_type(F.col("type_hint")).alias("asset_type"), F.lit(None).cast("string").alias("registration"), F.lit("bp").alias("source"), raw.alias("raw_data"))


def _unborn(found: DataFrame, assets: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows of ``found`` (user_id, received_at, import_id and ``name``) whose account has no asset of that key yet."""
    first = assets.withColumn(name, key).filter(F.col(name) != "").groupBy("user_id", name).agg(F.min("born").alias("_born"))
    late = F.col("_born").isNull() | (F.col("_born") > F.struct("received_at", "import_id"))
    return found.join(first, ["user_id", name], "left").filter(late).drop("_born")


def unseen_names(rows: DataFrame, assets: DataFrame, ignored: DataFrame, source: str, name: str = "vehicle_name") -> DataFrame:
    """Per import: the first row of each name that is no asset by then (``born``) and not ignored, as a pending asset. ``rows`` have ``header`` and ``cells``."""
    n = F.col(name)
    first = rows.filter(F.coalesce(name, F.lit("")) != "").groupBy("import_id", "received_at", "user_id", name).agg(F.min_by(F.struct("pos", "registration", "header", "cells"), "pos").alias("f"))
    fresh = _unborn(first, assets, F.col("asset_name"), name).join(ignored.select("user_id", X.js_trim(F.col("asset_name")).alias(name)).distinct(), ["user_id", name], "left_anti")
    return fresh.select("import_id", "received_at", F.col("f.pos").alias("pos"), "user_id", n.alias("asset_name"), X.detect_asset_type(n).alias("asset_type"), F.nullif("f.registration", F.lit("")).alias("registration"), F.lit(source).alias("source"), F.to_json(record_of(F.col("f.header"), F.transform("f.cells", X.js_trim))).alias("raw_data"))


def unseen_cards(rows: DataFrame, assets: DataFrame, ignored: DataFrame) -> DataFrame:
    """Per import of plain BP rows: cards without an asset by then (``born``), whose best name is neither an asset nor ignored, as pending assets."""
    low = F.lower(X.js_trim(F.col("asset_name")))
    came = rows.filter(F.col("card") != "").groupBy("import_id", "user_id", "card").agg(F.min("received_at").alias("received_at"), F.min("pos").alias("pos"))
    best = best_card_detail(rows).join(came, ["import_id", "user_id", "card"]).withColumn("_low", F.lower("asset_name"))
    fresh = _unborn(_unborn(best, assets, X.card(F.col("bp_card_number")), "card"), assets.withColumn("_low", low).drop("asset_name"), F.col("_low"), "_low")
    fresh = fresh.join(ignored.select("user_id", low.alias("_low")).distinct(), ["user_id", "_low"], "left_anti")
    raw = F.to_json(F.struct(F.col("card").alias("cardNumber"), F.col("type_hint").alias("typeHint")))
    return fresh.select("import_id", "received_at", "pos", "user_id", "asset_name", X.detect_asset_type(F.col("type_hint")).alias("asset_type"), F.lit(None).cast("string").alias("registration"), F.lit("bp").alias("source"), raw.alias("raw_data"))


def _arrival(rows: DataFrame) -> Column:
    """Where a row stands among all: by its file's arrival where rows have it."""
    return F.struct(*(c for c in ("received_at", "import_id", "pos") if c in rows.columns))


def new_stub_assets_bp(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets to create for valid unseen cards. Cards are unique over all accounts: one that any account has is left alone."""
    ok = rows.filter(X.valid_card(F.col("card"))).join(assets.select(X.card(F.col("bp_card_number")).alias("card")).distinct(), "card", "left_anti")
    first = ok.groupBy("card").agg(F.min_by(F.struct("user_id", "description", "driver"), _arrival(ok)).alias("f"), F.min(_arrival(ok)).alias("first"))
    name = X.stub_asset_name_bp(F.col("f.description"), F.col("f.driver"), F.col("card"))
    return first.select("f.user_id", name.alias("asset_name"), X.detect_asset_type(name).alias("asset_type"), F.lit("Diesel").alias("fuel_type"), F.col("card").alias("bp_card_number"), "first")


def new_stub_assets_mobil(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """As for BP but within the account, with the fuel type of the card's first known fuel in the file that makes the asset."""
    ok = rows.filter(X.valid_card(F.col("card"))).join(assets.select("user_id", X.card(F.col("mobil_card_number")).alias("card")).distinct(), ["user_id", "card"], "left_anti")
    order = _arrival(ok)
    first = ok.groupBy("user_id", "card").agg(F.min_by("description", order).alias("description"), F.min(F.when(X.mobil_fuel_product(F.col("product")), F.struct(order.alias("at"), "product"))).alias("fuel"), F.min(order).alias("first"))
    name = X.stub_asset_name_mobil(F.col("description"), F.col("card"))
    known = F.col("fuel.at.import_id") == F.col("first.import_id")
    kind = F.when(known, X.mobil_fuel_type(F.col("fuel.product"))).otherwise("Diesel")
    return first.select("user_id", name.alias("asset_name"), X.detect_asset_type(name).alias("asset_type"), kind.alias("fuel_type"), F.col("card").alias("mobil_card_number"), "first")


def _out_of_band(cost: Column, litres: Column) -> Column:
    price = F.try_divide(cost, litres)
    return (price < S.MIN_PRICE_PER_LITRE) | (price > S.MAX_PRICE_PER_LITRE)


def _positive_odometer() -> Column:
    return F.when(F.col("odometer") > 0, F.col("odometer"))


def _card_feed(rows: DataFrame, cost: Column, known: Column, source: str) -> DataFrame:
    r = rows.withColumn("cost_nzd", cost)
    reason = (
        F.when((F.col("card") == "") | F.col("purchase_date").isNull() | F.col("litres").isNull() | (F.col("litres") <= 0), "bad_key")
        .when(F.col("cost_nzd").isNull(), "no_cost").when(~known, "not_fuel").when(_out_of_band(F.col("cost_nzd"), F.col("litres")), "price_out_of_band").when(F.col("asset_id").isNull(), "no_asset")
    )
    return dedup_fuel_rows(r.withColumn("reject_reason", reason).withColumn("odometer_reading", _positive_odometer()).withColumn("source", F.lit(source)))


def clean_bp_transaction(rows: DataFrame) -> DataFrame:
    """``reject_reason`` (the first that holds; null: kept) and the columns of fuel_purchases. Rows are kept, for quarantine."""
    return _card_feed(rows, F.col("cost"), X.bp_fuel_product(F.col("product")), "bp-transaction")


def clean_mobil(rows: DataFrame) -> DataFrame:
    """As BP transactions; the total includes tax, so tax goes."""
    return _card_feed(rows, F.col("total") - F.coalesce("gst", F.lit(0.0)), X.mobil_fuel_product(F.col("product")), "mobil")


def clean_bp(rows: DataFrame) -> DataFrame:
    """Plain BP rows: litres of 0 or less and missing costs pass; repeated rows are left to the upsert."""
    band = F.col("cost").isNotNull() & (F.col("litres") > 0) & _out_of_band(F.col("cost"), F.col("litres"))
    reason = (
        F.when(F.col("card") == "", "no_card").when(F.col("asset_id").isNull(), "no_asset").when(F.col("purchase_date").isNull() | F.col("litres").isNull(), "bad_key")
        .when(~X.bp_fuel_product(F.col("product")), "not_fuel").when(band, "price_out_of_band")
    )
    return rows.withColumn("cost_nzd", F.col("cost")).withColumn("reject_reason", reason).withColumn("odometer_reading", F.lit(None).cast("double")).withColumn("source", F.lit("BP CSV"))


def dedup_fuel_rows(rows: DataFrame) -> DataFrame:
    """Of a file's kept rows with the same asset, day and litres the first stays; the others' reason is 'duplicate'.

    A later file with the same purchase is no duplicate: it overwrites the earlier row (see operators.upsert). Every
    rejected row is a group of its own, so rows of broken files do not meet in one task.
    """
    alone = F.when(F.col("reject_reason").isNotNull(), F.col("pos"))
    w = Window.partitionBy("import_id", "asset_id", "purchase_date", "litres", alone).orderBy("pos")
    again = F.col("reject_reason").isNull() & (F.row_number().over(w) > 1)
    return rows.withColumn("_again", again).withColumn("reject_reason", F.when(F.col("_again"), "duplicate").otherwise(F.col("reject_reason"))).drop("_again")


def fuel_purchases(cleaned: DataFrame) -> DataFrame:
    """The kept rows as fuel_purchases."""
    return cleaned.filter(F.col("reject_reason").isNull()).select("user_id", F.col("asset_id").alias("vehicle_id"), "purchase_date", "litres", "cost_nzd", "odometer_reading", "source")
