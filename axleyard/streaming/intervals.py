"""Fill-to-fill intervals with as-of odometers from a stream of fills and readings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S

_DAY_MS = 86_400_000
INTERVALS = "asset_id long, seq int, start_date date, end_date date, litres double, start_odo double, end_odo double"


class IntervalState(StatefulProcessor):
    """Fills of an asset that still wait, its last closed fill, and the readings that may still be asked for."""

    def __init__(self, reach: int = S.ODOMETER_SEARCH_DAYS):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fills = handle.getListState("fills", "day date, litres double, cost double")
        self.readings = handle.getMapState("readings", "day date", "odometer_km double")
        self.last = handle.getValueState("last", "day date, start_odo double, seq int")

    def _closes(self, day: dt.date) -> int:
        """When a fill's readings are all there: at the end of the last day that is searched."""
        return ((day - dt.date(1970, 1, 1)).days + self.reach + 1) * _DAY_MS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            days = pd.to_datetime(part["at"]).dt.date
            for day, kind, litres, cost, odometer in zip(days, part["kind"], part["litres"], part["cost"], part["odometer_km"]):
                if kind == "fill":
                    self.fills.appendValue((day, None if pd.isna(litres) else float(litres), None if pd.isna(cost) else float(cost)))
                    self.handle.registerTimer(self._closes(day))
                elif not pd.isna(odometer):
                    self.readings.updateValue((day,), (float(odometer),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        fills = sorted(self.fills.get(), key=lambda f: (f[0], f[1] is not None, f[1] or 0.0, f[2] is not None, f[2] or 0.0))
        done, rest = [f for f in fills if self._closes(f[0]) <= now], [f for f in fills if self._closes(f[0]) > now]
        if not done:
            return
        read = {k[0]: v[0] for k, v in self.readings.iterator()}
        near = lambda days: next((read[d] for d in days if d in read), None)
        step = [dt.timedelta(k) for k in range(self.reach + 1)]
        start, odo, seq = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for day, litres, _ in done:
            seq += 1
            if start is not None:
                out.append((key[0], seq, start, day, litres, odo, near(day - k for k in step)))
            start, odo = day, near(day + k for k in step)
        self.last.update((start, odo, seq))
        self.fills.put(rest) if rest else self.fills.clear()
        for day in [d for d in read if d < start - step[-1]]:
            self.readings.removeKey((day,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in INTERVALS.split(", ")])

    def close(self) -> None:
        pass


def stream_intervals(rows: DataFrame, wait: str = "3 days") -> DataFrame:
    """intervals_with_odometers (INTERVALS) of a stream ``rows`` (asset_id, at timestamp, kind 'fill' or 'odometer', litres, cost, odometer_km).

    An interval comes out once, when the days after its later fill that an odometer is searched in are over and ``wait`` has
    passed since; what arrives within that time counts. Needs the RocksDB state store. The state of an asset is the fills that wait
    and the readings since shortly before its last closed one.
    """
    keyed = rows.withWatermark("at", wait).select("asset_id", "at", "kind", "litres", "cost", "odometer_km")
    return keyed.groupBy("asset_id").transformWithStateInPandas(IntervalState(), INTERVALS, "Append", "EventTime")
