"""Arriving files as streams. Late and repeated files overwrite their keys, so each batch is an upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas as S
from ..operators import upsert as U
from ..operators.ingest import CELLS, Taken
from ..sources.versioned import VersionedTables
from ..tables import cut


def read_file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Each new file under ``path`` as a row (filename, received_at, raw_csv)."""
    s = spark.readStream.format("text").option("wholetext", True)
    s = (s.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else s).load(path)
    return s.select(F.url_decode("_metadata.file_name").alias("filename"), F.col("_metadata.file_modification_time").alias("received_at"), F.col("value").alias("raw_csv"))


#: Tables that a stream of files keeps. readings: of each asset and month the last odometer, and the last that is not 0.
STORE = {
    "telematics": S.TELEMATICS, "readings": "asset_id long, record_date date, odometer_km double", "fuel": S.FUEL_PURCHASES, "assets": S.ASSETS, "pending": "import_id string, " + S.PENDING_ASSETS,
    "status": "import_id string, format string, status string, error_message string, detected_category string, detected_headers string, records_upserted long, rows_skipped long, pending_added long", "rejects": "import_id string, reject_reason string, n_rows long",
}
STORE_KEYS = {"telematics": "asset_id", "readings": "asset_id", "fuel": "vehicle_id", "assets": "asset_id", "pending": "user_id", "status": "import_id", "rejects": "import_id"}


def month(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def last_readings(telematics: DataFrame) -> DataFrame:
    """Of each asset and month the last odometer, and the last that is not 0."""
    row = F.struct("record_date", "odometer_km")
    seen = telematics.filter("odometer_km IS NOT NULL").groupBy("asset_id", month("record_date").alias("month")).agg(F.max(row).alias("a"), F.max(F.when(F.col("odometer_km") != 0, row)).alias("b"))
    both = seen.select("asset_id", F.explode(F.array_distinct(F.filter(F.array("a", "b"), lambda x: x.isNotNull()))).alias("r"))
    return both.select("asset_id", "r.record_date", "r.odometer_km")


def fleet_store(spark: SparkSession, path: str, assets: DataFrame | None = None, telematics: DataFrame | None = None, fuel: DataFrame | None = None) -> VersionedTables:
    """The tables under ``path``; where there are none yet they begin with ``assets``, ``telematics`` and ``fuel`` as version 0."""
    store = VersionedTables(spark, path, STORE, STORE_KEYS)
    if not store.versions():
        begin = {}
        if telematics is not None:
            begin |= {"telematics": (telematics, month("record_date")), "readings": (last_readings(telematics), month("record_date"))}
        if fuel is not None:
            begin["fuel"] = (fuel, month("purchase_date"))
        columns = [c.split()[0] for c in S.ASSETS.split(", ")]
        kept = {} if assets is None else {"assets": assets.select(*(F.col(c) if c in assets.columns else F.lit(None).alias(c) for c in columns))}
        store.commit(0, begin, kept)
    return store


def _months(rows: DataFrame, day: str) -> set[str]:
    return {r[0] for r in rows.select(month(day)).distinct().collect()}  # a few for each batch


def take_batch(files: DataFrame, store: VersionedTables, version: int, ignored: DataFrame) -> None:
    """Takes a batch of files of all formats (FILE_COLUMNS, raw_csv) into ``store`` as ``version``.

    Only the months that the batch has rows of are read and written, besides assets, pending assets and, for the odometers to
    run on from, the last readings of other months.
    """
    if version in store.versions():
        return
    old = store.manifest(version)
    read: dict[str, list[str]] = {}

    def readings(steps: DataFrame) -> DataFrame:
        months = read["steps"] = _months(steps, "record_date")
        return store.read("telematics", old, months).select("asset_id", "record_date", "odometer_km").unionByName(store.read("readings", old, but=months))

    t = Taken(files, store.read("assets", old), ignored, store.read("pending", old), readings)
    days, buys = _months(t.cells, "record_date"), _months(t.bought, "purchase_date")
    telematics = cut(U.upsert_cells(store.read("telematics", old, days), t.cells, CELLS))
    fuel = U.upsert_fuel(store.read("fuel", old, buys), t.bought)
    by = month("record_date")
    note = {"read_bytes": {"telematics": store.bytes_of("telematics", old, days | read["steps"]), "fuel": store.bytes_of("fuel", old, buys)}, "months": {"telematics": sorted(days), "fuel": sorted(buys)}}
    store.commit(version, {"telematics": (telematics, by), "readings": (last_readings(telematics), by), "fuel": (fuel, month("purchase_date"))}, {"assets": t.made, "pending": t.queued, "status": t.status, "rejects": t.rejects}, note)


def stream_ingest(files: DataFrame, store: VersionedTables, account: Callable[[DataFrame], DataFrame], checkpoint: str, ignored: DataFrame | None = None) -> StreamingQuery:
    """Takes arriving files of all formats into ``store``, each batch as one version.

    ``account`` adds user_id to the files. A batch that runs again after a failure starts from the version before its own, and
    one that has been committed does nothing. As files arrive in order, the tables are those of one ingest of all files, however they are batched.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        own = VersionedTables(df.sparkSession, store.path, store.schemas, store.keys)
        no = df.sparkSession.createDataFrame([], "user_id long, asset_name string")
        take_batch(cut(account(df.withColumn("import_id", F.col("filename")))), own, batch_id + 1, no if ignored is None else ignored)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OdometerState(StatefulProcessor):
    """The running odometer of an asset: each new day's distance is added to what is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("odometer", "odometer_km double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        total = self.total.get()[0] if self.total.exists() else None
        for part in [pd.concat(list(rows))]:
            part = part.sort_values(["received_at", "import_id", "first_pos"], kind="stable")
            if total is None:
                first = part["base"].iloc[0]
                total = 0.0 if pd.isna(first) else float(first)
            run = total + part["distance"].cumsum()
            total = float(run.iloc[-1])
            yield pd.DataFrame({"asset_id": key[0], "record_date": part["record_date"], "odometer_km": run})
        self.total.update((total,))

    def close(self) -> None:
        pass


def stream_running_odometer(daily: DataFrame) -> DataFrame:
    """(asset_id, record_date, odometer_km) of a stream of daily mileage (asset_id, record_date, distance, base, received_at, import_id, first_pos).

    Needs the RocksDB state store. An asset's rows of one batch are at most its days in the new files.
    """
    return daily.groupBy("asset_id").transformWithStateInPandas(OdometerState(), "asset_id long, record_date date, odometer_km double", "Append", "None")
