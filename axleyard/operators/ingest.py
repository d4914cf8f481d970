"""A mixed folder of report files taken in at once: detect, parse, create and match assets, clean, upsert, status."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..sources import records as R
from ..sources.files import classify_unknown, detect_format
from ..tables import cut, stored
from . import resolve
from . import telematics as T
from . import upsert as U
from .odometers import odometers_in_order

#: What a pending asset's source says of each feed.
PENDING_SOURCES = {"exec_summary": "navman", "idle": "navman-idle", "mileage": "navman-mileage"}
#: Formats whose rows name their vehicles.
NAMED = tuple(PENDING_SOURCES)
HOURS = ["operating_hours", "idle_hours", "total_engine_hours"]
CELLS = [*HOURS, "odometer_km", "litres_consumed"]
WAITING = ["import_id", "user_id", "asset_name", "asset_type", "registration", "source", "raw_data"]
#: Ids of assets that an ingest makes have this bit, which no counted id reaches.
MADE = 2**62
#: Up to so many assets are sent to rows that look for theirs; beyond, both are shuffled.
SENT_ROWS = 600_000


def made_id(feed: str, *key: Column) -> Column:
    """The id of an asset made of a card: it follows from the card alone, so neither retries nor batches change it."""
    return F.xxhash64(F.lit(feed), *key).bitwiseAND(F.lit(MADE - 1)).bitwiseOR(F.lit(MADE))


def with_stubs(assets: DataFrame, stubs: DataFrame, asset_id: Column) -> DataFrame:
    """``assets`` and the new ones ``stubs``, each born where its card first came."""
    none = lambda t: F.lit(None).cast(t)
    kinds = dict(assets.dtypes)
    fresh = stubs.withColumn("asset_id", asset_id).withColumn("born", F.struct("first.received_at", "first.import_id"))
    fresh = stored(fresh.select(*((F.col(c).cast(kinds[c]) if c in fresh.columns else none(kinds[c])).alias(c) for c in assets.columns)))
    return assets.unionByName(fresh)


def _cells(writes: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """(asset_id, record_date, user_id and CELLS): of each cell the value that the last file and row wrote, as struct(value)."""
    rows = None
    for df, columns in writes:
        at = [F.col(c) for c in ("received_at", "import_id", "pos")]
        part = df.select("asset_id", "record_date", F.struct(*at, "user_id").alias("user"), *((F.struct(*at, F.col(c).cast("double").alias("value")) if c in columns else F.lit(None)).alias(c) for c in CELLS))
        rows = part if rows is None else rows.unionByName(part)
    last = lambda c: F.when(F.max(c).isNotNull(), F.struct(F.max(c)["value"].alias("value"))).alias(c)
    return rows.groupBy("asset_id", "record_date").agg(F.max("user")["user_id"].alias("user_id"), *(last(c) for c in CELLS))


class Taken:
    """What all files of ``files`` (FILE_COLUMNS and raw_csv) bring, over tables that it does not read.

    As if the files were taken in one by one, in the order in which they came (received_at, then
    import_id): a row meets the assets that its own file or an earlier one made of unseen cards; names and plain BP cards
    unseen by then wait as pending assets (the first of each name stays) and their rows are skipped; a cell, or a
    purchase, is what the last file wrote; odometers of both feeds run on from each other. ``pending`` has the assets
    that wait already; ``readings`` gives (asset_id, record_date, odometer_km) of the table before, for the odometer steps it is handed.

    ``cells`` and ``bought`` are by the keys of telematics and fuel, ``known`` the assets by the end and ``made`` the new ones, ``queued`` the
    pending assets, ``status`` and ``rejects`` what happened to each file and row. Each is computed, and each step that it needs
    stored, when it is first asked for.
    """

    def __init__(self, files: DataFrame, assets: DataFrame, ignored: DataFrame, pending: DataFrame | None, readings: Callable[[DataFrame], DataFrame], order: list[str] | None = None):
        self._given, self._assets, self._ignored, self._pending, self._readings, self._order = files, assets, ignored, pending, readings, order or S.BULK_ORDER
        self._parsed: dict[str, DataFrame] = {}

    @cached_property
    def _files(self) -> DataFrame:
        category, header = classify_unknown(F.col("raw_csv"))
        came = F.coalesce("received_at", F.timestamp_seconds(F.lit(0)))
        files = detect_format(self._given.withColumn("received_at", came), self._order)
        unknown = F.col("format") == "unknown"
        return stored(files.withColumns({"detected_category": F.when(unknown, category), "detected_headers": F.when(unknown, header)}), "format")

    def _rows(self, name: str) -> DataFrame:
        """The typed rows of one format."""
        if name not in self._parsed:
            rows = R.typed_rows(self._files, name).drop("filename", "format")
            rows = rows.withColumn("vehicle_name", X.js_trim(F.col("vehicle_name"))) if name in NAMED else rows.drop("header", "cells")
            self._parsed[name] = stored(rows)
        return self._parsed[name]

    @cached_property
    def _stubs(self) -> tuple[DataFrame, DataFrame]:
        """Assets with ``born``: those there were and those made of BP cards, and with those made of Mobil cards."""
        kind = self._files.schema["import_id"].dataType.simpleString()
        before = F.struct(F.lit("0001-01-01").cast("timestamp").alias("received_at"), F.lit(None).cast(kind).alias("import_id"))
        old = stored(self._assets.withColumn("asset_id", F.col("asset_id").cast("long")).withColumn("born", before))
        bp = with_stubs(old, resolve.new_stub_assets_bp(self._rows("bp_transaction"), old), made_id("bp", F.col("bp_card_number")))
        return bp, with_stubs(bp, resolve.new_stub_assets_mobil(self._rows("mobil"), bp), made_id("mobil", F.col("user_id"), F.col("mobil_card_number")))

    @property
    def _known(self) -> DataFrame:
        return self._stubs[1]

    @cached_property
    def _few(self) -> bool:
        return self._known.count() <= SENT_ROWS

    @property
    def known(self) -> DataFrame:
        return self._known.drop("born")

    @property
    def made(self) -> DataFrame:
        return self._known.filter(F.col("born.import_id").isNotNull()).drop("born")

    @cached_property
    def _cleaned(self) -> DataFrame:
        tx, mobil, plain = map(self._rows, ("bp_transaction", "mobil", "bp"))
        fuel_rows = [
            resolve.clean_bp_transaction(resolve.join_by_card(tx, self._known, few=self._few)), resolve.clean_mobil(resolve.join_by_card(mobil, self._known, "mobil_card_number", few=self._few)),
            resolve.clean_bp(resolve.join_card_then_name(plain, self._known, self._ignored, self._few)),
        ]
        narrow = ("import_id", "user_id", "received_at", "pos", "asset_id", "purchase_date", "litres", "cost_nzd", "odometer_reading", "source", "reject_reason")
        cleaned = fuel_rows[0].select(*narrow)
        for part in fuel_rows[1:]:
            cleaned = cleaned.unionByName(part.select(*narrow))
        return stored(cleaned)

    @cached_property
    def bought(self) -> DataFrame:
        kept = self._cleaned.filter(F.col("reject_reason").isNull())
        bought = U.last_by_key(kept.withColumn("vehicle_id", F.col("asset_id")), ["vehicle_id", "purchase_date", "litres"], [F.desc("received_at"), F.desc("import_id"), F.desc("pos")])
        return stored(bought.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in S.FUEL_PURCHASES.split(", "))))

    @cached_property
    def _unseen(self) -> DataFrame:
        unseen = resolve.unseen_cards(self._rows("bp"), self._known, self._ignored)
        for n in NAMED:
            unseen = unseen.unionByName(resolve.unseen_names(self._rows(n), self._known, self._ignored, PENDING_SOURCES[n]))
        return stored(unseen)

    @cached_property
    def queued(self) -> DataFrame:
        queued = U.last_by_key(self._unseen, ["user_id", "asset_name"], [F.asc("received_at"), F.asc("import_id"), F.asc("pos")])
        if self._pending is not None:
            queued = queued.join(self._pending.select("user_id", "asset_name").distinct(), ["user_id", "asset_name"], "left_anti")
        return cut(queued.select(*WAITING))

    @cached_property
    def _matched(self) -> dict[str, DataFrame]:
        return {n: resolve.join_by_name(self._rows(n).drop("header", "cells"), self._known, few=self._few) for n in NAMED}

    @cached_property
    def _exec(self) -> DataFrame:
        arrived = self._matched["exec_summary"].select("import_id", "received_at").distinct()
        return T.clean_exec_summary(self._matched["exec_summary"]).join(arrived, "import_id")

    @cached_property
    def cells(self) -> DataFrame:
        ex_kept = self._exec.filter("reject_reason is null")
        per_file = ("import_id", "received_at", "user_id")
        idle = T.daily_idle(self._matched["idle"].filter("asset_id is not null"), per_file)
        daily = T.idle_plausibility(idle, per_file).filter("idle_hours is not null").withColumn("pos", F.lit(0))
        mileage = T.daily_mileage(self._matched["mileage"].filter("asset_id is not null"), ("import_id", "received_at", "user_id")).withColumnRenamed("first_pos", "pos")
        step = lambda df, feed: df.select("asset_id", "received_at", "import_id", "pos", F.lit(feed).alias("feed"), "record_date", "distance")
        steps = stored(step(ex_kept, "exec").unionByName(step(mileage, "mileage")))
        odo = odometers_in_order(steps, self._readings(steps), self._known)
        users = ex_kept.select(*per_file, "asset_id", "pos", "record_date").unionByName(mileage.select(*per_file, "asset_id", "pos", "record_date"))
        odo = odo.join(users, ["import_id", "asset_id", "pos", "record_date"]).withColumn("litres_consumed", F.lit(None).cast("double"))
        return stored(_cells([(ex_kept, HOURS), (daily, ["idle_hours"]), (odo, ["odometer_km", "litres_consumed"])]))

    @cached_property
    def _judged(self) -> DataFrame:
        """Every parsed row's import and reject_reason."""
        seen = ["import_id", "reject_reason"]
        unmatched = F.when(F.col("asset_id").isNull(), "no_asset")
        usable = lambda n, ok: self._matched[n].withColumn("reject_reason", F.coalesce(F.when(~F.coalesce(ok, F.lit(False)), "bad_row"), unmatched)).select(*seen)
        named = self._exec.select(*seen).unionByName(usable("idle", F.col("record_date").isNotNull() & (F.col("duration") > 0) & F.lower(F.coalesce("unit", F.lit(""))).isin("", "min"))).unionByName(usable("mileage", F.col("record_date").isNotNull() & (F.col("distance") > 0)))
        return self._cleaned.select(*seen).unionByName(stored(named))

    @cached_property
    def status(self) -> DataFrame:
        status = U.import_status(self._files.select("import_id", "format", "detected_category", "detected_headers"), self._judged)
        return cut(status.join(U.import_summary(self._judged, self._unseen), "import_id", "left"))

    @cached_property
    def rejects(self) -> DataFrame:
        return U.reject_counts(self._judged)


class Ingested:
    """The tables after taking in all files at once: each is computed when it is first asked for. ``taken``: what the files bring to the tables before."""

    def __init__(self, taken: Taken, telematics: DataFrame, fuel: DataFrame, pending: DataFrame | None):
        self._taken, self._telematics, self._fuel, self._pending = taken, telematics, fuel, pending

    @cached_property
    def telematics(self) -> DataFrame:
        return U.upsert_cells(self._telematics, self._taken.cells, CELLS)

    @cached_property
    def fuel(self) -> DataFrame:
        return U.upsert_fuel(self._fuel, self._taken.bought)

    @property
    def assets(self) -> DataFrame:
        return self._taken.known

    @property
    def pending(self) -> DataFrame:
        return self._taken.queued if self._pending is None else self._pending.select(*WAITING).unionByName(self._taken.queued)

    @property
    def status(self) -> DataFrame:
        return self._taken.status

    @property
    def rejects(self) -> DataFrame:
        return self._taken.rejects


def ingest_files(files: DataFrame, assets: DataFrame, ignored: DataFrame, telematics: DataFrame, fuel: DataFrame, order: list[str] | None = None, pending: DataFrame | None = None) -> Ingested:
    """The tables after taking in all files at once, see Taken."""
    return Ingested(Taken(files, assets, ignored, pending, lambda steps: telematics, order), telematics, fuel, pending)
