"""Calibration that follows a store of tables batch by batch: only assets with new reports or fills are fitted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import calibrate as K
from ..operators import intervals as I
from ..sources.versioned import VersionedTables
from ..tables import cut

#: intervals: every interval of an asset as it is now. audit: also those that later fills made void. rates: a row per asset.
TABLES = {
    "intervals": "seq int, " + S.CALIBRATION_INTERVALS, "audit": S.CALIBRATION_INTERVALS,
    "rates": "asset_id long, calibrated boolean, reason string, included_count long, travel_rate_lpk double, raw_rate double, was_capped boolean, r2 double, idle_rate_lph double, idle_rate_floor_triggered boolean",
}
BUCKETS = 64


def bucket(asset: str = "asset_id"):
    """The partition of an asset: all its rows, and those of some others."""
    return F.format_string("%02d", F.pmod(F.xxhash64(F.col(asset).cast("long")), F.lit(BUCKETS)))


def calibration_store(spark, path: str) -> VersionedTables:
    return VersionedTables(spark, path, TABLES, dict.fromkeys(TABLES, "asset_id"))


def recalibrate(store: VersionedTables, version: int, touched: DataFrame, fuel: DataFrame, telematics: DataFrame, assets: DataFrame, holidays: DataFrame | None = None) -> None:
    """Brings ``store`` up to date as ``version``: assets of ``touched`` (asset_id) are evaluated and fitted from ``fuel`` and ``telematics``.

    An asset's intervals, and so its rates, depend on its own rows alone: a late report or fill makes void what its
    asset had, and nothing else. Other assets of the same partitions are copied. The result is that of a run over all assets; travel
    rates are capped against those of ``assets``. Running a version again changes nothing.
    """
    if version in store.versions():
        return
    old = store.manifest(version)
    own = cut(touched.select(F.col("asset_id").cast("long").alias("asset_id")).distinct())
    parts = {r[0] for r in own.select(bucket()).distinct().collect()}  # 64 at most
    purchases = fuel.join(own.withColumnRenamed("asset_id", "vehicle_id"), "vehicle_id", "left_semi")
    merged = cut(I.merge_orphaned_litres(I.evaluate_intervals(purchases, telematics.join(own, "asset_id", "left_semi"), holidays)))
    rest = lambda name: store.read(name, old, parts).join(own, "asset_id", "left_anti")
    named = merged.withColumnsRenamed({"start_date": "interval_start_date", "end_date": "interval_end_date"}).select(*(c.split()[0] for c in TABLES["intervals"].split(", ")))
    fitted = K.calibrate_assets(merged, assets).select(*(c.split()[0] for c in TABLES["rates"].split(", ")))
    audit = I.upsert_audit(store.read("audit", old, parts), merged)
    store.commit(version, {"intervals": (rest("intervals").unionByName(named), bucket()), "audit": (audit, bucket()), "rates": (rest("rates").unionByName(fitted), bucket())}, {}, {"assets": own.count(), "parts": sorted(parts)})
