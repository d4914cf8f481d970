"""Fill-to-fill intervals: odometers at both ends, data gaps, exclusion reasons, litres carried forward.

All windows lead with the asset, so an asset's rows meet once; an asset has at most a few thousand days.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..tables import cut

NPD, MERGED = "non_positive_distance", "non_positive_distance_litres_merged_forward"


def _day(c) -> Column:
    return F.unix_date(c)


def _fills(purchases: DataFrame) -> DataFrame:
    """Fills in order: ties on a day by litres, then cost."""
    order = Window.partitionBy("vehicle_id").orderBy("purchase_date", "litres", "cost_nzd")
    return purchases.select(F.col("vehicle_id").alias("asset_id"), "purchase_date", "litres", F.row_number().over(order).alias("seq"))


def build_intervals(purchases: DataFrame) -> DataFrame:
    """(asset_id, seq, start_date, end_date, litres): consecutive fills; the litres are those of the later one."""
    f = _fills(purchases)
    prev = F.lag("purchase_date").over(Window.partitionBy("asset_id").orderBy("seq"))
    return f.select("asset_id", "seq", prev.alias("start_date"), F.col("purchase_date").alias("end_date"), "litres").filter("seq > 1")


def asof_odometers(points: DataFrame, telematics: DataFrame, days: int = S.ODOMETER_SEARCH_DAYS) -> DataFrame:
    """``points`` (asset_id, day date, ...) with the nearest odometer within ``days`` after (odo_forward) and before (odo_backward)."""
    cols = points.columns
    both = points.withColumn("_odo", F.lit(None).cast("double")).withColumn("_point", F.lit(True)).unionByName(
        telematics.filter(F.col("odometer_km").isNotNull()).select("asset_id", F.col("record_date").alias("day"), F.col("odometer_km").alias("_odo"), F.lit(False).alias("_point")), allowMissingColumns=True)
    w = Window.partitionBy("asset_id").orderBy(_day("day"))
    out = both.withColumn("odo_forward", F.first("_odo", ignorenulls=True).over(w.rangeBetween(0, days))).withColumn("odo_backward", F.last("_odo", ignorenulls=True).over(w.rangeBetween(-days, 0)))
    return out.filter("_point").select(*cols, "odo_forward", "odo_backward")


def intervals_with_odometers(purchases: DataFrame, telematics: DataFrame) -> DataFrame:
    """build_intervals with start_odo (searched forward from the start) and end_odo (backward from the end)."""
    f = asof_odometers(_fills(purchases).withColumnRenamed("purchase_date", "day"), telematics)
    w = Window.partitionBy("asset_id").orderBy("seq")
    return f.select("asset_id", "seq", F.lag("day").over(w).alias("start_date"), F.col("day").alias("end_date"), "litres", F.lag("odo_forward").over(w).alias("start_odo"), F.col("odo_backward").alias("end_odo")).filter("seq > 1")


def interval_days(intervals: DataFrame, telematics: DataFrame) -> DataFrame:
    """One row per day of [start, end) of each interval with the day's telematics: an interval join made an equi-join."""
    days = intervals.filter("end_date > start_date").select("asset_id", "seq", F.explode(F.sequence("start_date", F.date_sub("end_date", 1))).alias("record_date"))
    tel = telematics.select("asset_id", "record_date", "odometer_km", "idle_hours", F.lit(True).alias("has_row"))
    return days.join(tel, ["asset_id", "record_date"], "left")


class WorkingDays:
    """Monday to Friday without holidays, as expressions over day numbers (days since 1970), in closed form.

    ``holidays`` (holiday_date) is a calendar: its few days become part of the expressions. Without it ``schemas.HOLIDAYS`` hold.
    """

    def __init__(self, holidays: DataFrame | None = None):
        days = [date.fromisoformat(d) for d in S.HOLIDAYS] if holidays is None else [r[0] for r in holidays.select("holiday_date").distinct().collect() if r[0]]
        self.free = sorted((d - date(1970, 1, 1)).days for d in days if d.weekday() < 5)
        off = set(self.free)
        works = lambda d: (d + 3) % 7 < 5 and d not in off
        self.breaks = {}  # the first working day after a stretch that is too long for a run: the last one before it
        for d in self.free:
            before, after = d - 1, d + 1
            while not works(before):
                before -= 1
            while not works(after):
                after += 1
            if after - before > S.MAX_GAP_RUN_DAYS:
                self.breaks[after] = before

    def _list(self, days) -> Column:
        return F.lit(sorted(days)).cast("array<int>") if days else F.array().cast("array<int>")

    def until(self, day: Column) -> Column:
        """Working days up to ``day``, from some fixed day on."""
        week = day + 3  # day 0 is a Thursday; weeks begin on Mondays
        free = F.size(F.filter(self._list(self.free), lambda h: h <= day))
        return (F.floor(week / 7) * 5 + F.least(F.pmod(week, F.lit(7)) + 1, F.lit(5)) - free).cast("int")

    def on(self, day: Column) -> Column:
        return (F.pmod(day + 3, F.lit(7)) < 5) & ~F.array_contains(self._list(self.free), day)

    def stretches(self, start: Column, end: Column) -> Column:
        """The working days of [start, end] as structs (first, last, n), cut where two of them are further apart than a run allows.

        Between working days of one run are two other days at most, so its first and last are found by looking at three days;
        one that ends where no run goes on ends with the last working day before that.
        """
        cuts = F.filter(self._list(self.breaks), lambda b: (b > start) & (b <= end))
        from_, to = F.concat(F.array(start), cuts), F.concat(F.transform(cuts, lambda b: b - 1), F.array(end))
        near = lambda d, way: F.when(self.on(d), d).when(self.on(d + way), d + way).otherwise(d + 2 * way)

        def last(day):
            if not self.breaks:
                return near(day, -1)
            pairs = F.arrays_zip(self._list(self.breaks).alias("after"), self._list(self.breaks.values()).alias("before"))
            within = F.filter(pairs, lambda p: (day > p["before"]) & (day < p["after"]))
            return F.coalesce(F.get(within, F.lit(0))["before"], near(day, -1))

        parts = F.zip_with(from_, to, lambda a, z: F.struct(near(a, 1).alias("first"), last(z).alias("last"), (self.until(z) - self.until(a - 1)).alias("n")))
        return F.filter(parts, lambda p: p["n"] > 0)


def _longest(pieces: Column) -> Column:
    """Of working days as structs (first, last, n): the longest run, where pieces at most three days apart are one; null without any."""
    step = lambda run, s, p: F.struct(F.greatest(s["best"], run).alias("best"), run.alias("run"), p["last"].alias("last"))
    begin = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit(-(10**8)).alias("last"))
    walk = F.aggregate(F.array_sort(pieces), begin, lambda s, p: step(F.when(p["first"] - s["last"] <= S.MAX_GAP_RUN_DAYS, s["run"]).otherwise(0) + p["n"], s, p), lambda s: s["best"])
    return F.when(F.size(pieces) > 0, walk).cast("long")


def interval_facts(purchases: DataFrame, telematics: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """build_intervals with start_odo, end_odo, idle_hours, and the longest runs of working days without a report
    (max_missing_run) and of reported ones without an odometer (max_odometer_run); null where there are none.

    Fills and telematics rows of an asset stand in one order, in which every report falls into one interval; what lies
    between two reports is counted in closed form. So these rows are exchanged, by asset and once, and no interval is spread over its days.
    """
    days = WorkingDays(holidays)
    fills = _fills(purchases).select("asset_id", _day("purchase_date").alias("d"), F.lit(0).alias("kind"), F.col("seq").alias("fill"), F.col("purchase_date").alias("day"), "litres")
    tel = telematics.select("asset_id", _day("record_date").alias("d"), F.lit(1).alias("kind"), "odometer_km", F.coalesce("idle_hours", F.lit(0.0)).alias("idle_hours"))
    by_day, w = Window.partitionBy("asset_id").orderBy("d"), Window.partitionBy("asset_id").orderBy("d", "kind", "fill")
    past, reach = w.rowsBetween(Window.unboundedPreceding, -1), S.ODOMETER_SEARCH_DAYS
    is_fill, odo = F.col("kind") == 0, F.col("odometer_km")
    rows = fills.unionByName(tel, allowMissingColumns=True)
    rows = rows.withColumn("forward", F.first(odo, ignorenulls=True).over(by_day.rangeBetween(0, reach))).withColumn("backward", F.last(odo, ignorenulls=True).over(by_day.rangeBetween(-reach, 0)))
    # the day before: the last report in the interval, or the day before its start, whose own report counts
    rows = rows.withColumns({
        "seq": (F.count("fill").over(past) + 1).cast("int"), "after": F.lag(F.col("d") - F.when(is_fill, 1).otherwise(0)).over(w),
        "start": F.last(F.when(is_fill, F.struct("day", F.col("forward").alias("odo"))), ignorenulls=True).over(past),
    })
    blank = ~is_fill & odo.isNull() & days.on(F.col("d"))
    one = F.struct(F.col("d").alias("first"), F.col("d").alias("last"), F.lit(1).alias("n"))
    gap = F.when(F.col("d") - F.col("after") > 1, days.stretches(F.col("after") + 1, F.col("d") - 1))
    g = rows.filter("seq > 1").groupBy("asset_id", "seq").agg(
        F.max(F.when(is_fill, F.struct(F.col("start.day").alias("start_date"), F.col("day").alias("end_date"), "litres", F.col("start.odo").alias("start_odo"), F.col("backward").alias("end_odo")))).alias("f"),
        F.sum(F.when(~is_fill, F.col("idle_hours"))).alias("idle_hours"), F.flatten(F.collect_list(gap)).alias("gaps"), F.collect_list(F.when(blank, one)).alias("blanks"),
    )
    # reports behind the last fill are in an interval that no fill ends
    return g.filter("f IS NOT NULL").select("asset_id", "seq", "f.*", F.coalesce("idle_hours", F.lit(0.0)).alias("idle_hours"), _longest(F.col("gaps")).alias("max_missing_run"), _longest(F.col("blanks")).alias("max_odometer_run"))


def missing_weekday_runs(purchases: DataFrame, telematics: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    return interval_facts(purchases, telematics, holidays).filter("max_missing_run IS NOT NULL").select("asset_id", "seq", "max_missing_run")


def missing_odometer_runs(purchases: DataFrame, telematics: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    return interval_facts(purchases, telematics, holidays).filter("max_odometer_run IS NOT NULL").select("asset_id", "seq", "max_odometer_run")


def evaluate_intervals(purchases: DataFrame, telematics: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Distance, idle hours, the first exclusion reason that holds, and ``included``. Litres are not carried forward yet."""
    j = interval_facts(purchases, telematics, holidays).withColumn("distance_km", F.col("end_odo") - F.col("start_odo"))
    reason = (
        F.when(F.col("distance_km").isNull(), "missing_odometer_boundary").when(F.col("distance_km") <= 0, NPD).when(F.col("max_missing_run") >= S.MIN_GAP_RUN, "telematics_gap")
        .when(F.col("max_odometer_run") >= S.MIN_GAP_RUN, "odometer_gap").when(F.col("litres").isNull() | (F.col("litres") <= 0), "invalid_litres").when(F.col("litres") < S.MIN_PLAUSIBLE_FILL_LITRES, "implausible_litres")
    )
    return j.select("asset_id", "seq", "start_date", "end_date", "distance_km", "litres", "idle_hours", reason.isNull().alias("included"), reason.alias("exclusion_reason"))


def merge_orphaned_litres(evaluated: DataFrame) -> DataFrame:
    """Litres of intervals without distance go on to the next interval, through chains of them; the last one keeps its reason."""
    w = Window.partitionBy("asset_id").orderBy("seq")
    e = evaluated.withColumn("_after", F.coalesce(F.lag("exclusion_reason").over(w) == NPD, F.lit(False)))
    e = e.withColumn("_chain", F.sum(F.when(F.col("_after"), 0).otherwise(1)).over(w))
    run = Window.partitionBy("asset_id", "_chain").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    litres = F.when(F.col("_after"), F.sum(F.coalesce("litres", F.lit(0.0))).over(run)).otherwise(F.col("litres"))
    reason = F.when((F.col("exclusion_reason") == NPD) & F.lead("seq").over(w).isNotNull(), MERGED).otherwise(F.col("exclusion_reason"))
    return e.withColumn("_litres", litres).withColumn("_reason", reason).withColumn("litres", F.col("_litres")).withColumn("exclusion_reason", F.col("_reason")).drop("_after", "_chain", "_litres", "_reason")


def audit_rows(merged: DataFrame) -> DataFrame:
    """The audit table's rows: the first interval of each (asset, start, end)."""
    w = Window.partitionBy("asset_id", "start_date", "end_date").orderBy("seq")
    return merged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        "asset_id", F.col("start_date").alias("interval_start_date"), F.col("end_date").alias("interval_end_date"), "distance_km", "litres", "idle_hours", "included", "exclusion_reason")


def upsert_audit(target: DataFrame, merged: DataFrame, small_rows: int = 200_000) -> DataFrame:
    """The audit table after an upsert of every evaluated interval; the table is shuffled only if those are many."""
    key = ["asset_id", "interval_start_date", "interval_end_date"]
    fresh = cut(audit_rows(merged))
    own = fresh.select(*key)
    small = own.limit(small_rows + 1).count() <= small_rows
    return target.join(F.broadcast(own) if small else own, key, "left_anti").unionByName(fresh)
