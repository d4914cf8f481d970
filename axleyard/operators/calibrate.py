"""Fuel rates from included intervals: per asset, and pooled by idle class within each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..tables import cut


def slope(xy: Column, xx: Column) -> Column:
    return F.when(xx > 0, xy / xx).otherwise(0.0)


def regress_origin(points: DataFrame, keys: list[str], x: str = "distance_km", y: str = "litres") -> DataFrame:
    """Through-origin regression per group: slope (not below 0), raw_slope, r2 (uncentred; null without variation), n."""
    g = points.groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.count("*").alias("n"))
    raw = slope(F.col("sxy"), F.col("sxx"))
    b = F.greatest(raw, F.lit(0.0))
    residual = F.greatest(F.col("syy") - 2 * b * F.col("sxy") + b * b * F.col("sxx"), F.lit(0.0))
    return g.select(*keys, b.alias("slope"), raw.alias("raw_slope"), F.when(F.col("syy") > 0, 1 - residual / F.col("syy")).alias("r2"), "n")


def calibrate_assets(merged: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per asset with intervals: travel rate (capped against the previous one), R2, idle rate, flags."""
    inc = merged.filter("included")
    reg = regress_origin(inc, ["asset_id"])
    sums = inc.groupBy("asset_id").agg(F.sum("litres").alias("_litres"), F.sum("distance_km").alias("_km"), F.sum("idle_hours").alias("_idle"))
    j = merged.select("asset_id").distinct().join(reg, "asset_id", "left").join(sums, "asset_id", "left").join(assets.select("asset_id", F.col("travel_rate_lpk").alias("_prev")), "asset_id", "left")
    n = F.coalesce("n", F.lit(0))
    ok = n >= S.MIN_INTERVALS_TO_CALIBRATE
    low, high = F.col("_prev") * (1 - S.RATE_CHANGE_CAP), F.col("_prev") * (1 + S.RATE_CHANGE_CAP)
    capped = F.coalesce((F.col("_prev") > 0) & ((F.col("slope") < low) | (F.col("slope") > high)), F.lit(False))
    rate = F.when(F.col("_prev") > 0, F.least(F.greatest("slope", low), high)).otherwise(F.col("slope"))
    left = F.col("_litres") - rate * F.col("_km")
    return j.select(
        "asset_id", ok.alias("calibrated"), F.when(~ok, "insufficient_intervals").alias("reason"), n.cast("long").alias("included_count"), F.when(ok, rate).alias("travel_rate_lpk"), F.when(ok, F.col("slope")).alias("raw_rate"), (ok & capped).alias("was_capped"),
        F.when(ok, F.col("r2")).alias("r2"), F.when(ok & (F.col("_idle") > 0), F.greatest(left, F.lit(0.0)) / F.col("_idle")).alias("idle_rate_lph"), (ok & (left < 0)).alias("idle_rate_floor_triggered"),
    )


def idle_anomaly(results: DataFrame, assets: DataFrame) -> DataFrame:
    """``anomalous``: an idle rate more than half above the previous one, which nobody has confirmed."""
    a = assets.select("asset_id", F.col("idle_burn_rate_lph").alias("_old"), F.coalesce("idle_anomaly_confirmed", F.lit(False)).alias("_confirmed"))
    j = results.join(a, "asset_id", "left")
    flag = (F.col("_old") > 0) & ((F.col("idle_rate_lph") - F.col("_old")) / F.nullif("_old", F.lit(0.0)) > S.IDLE_ANOMALY_CHANGE) & ~F.col("_confirmed")
    return j.withColumn("anomalous", F.coalesce(flag, F.lit(False))).drop("_old", "_confirmed")


def apply_calibration(assets: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The assets after calibration. An idle rate that is not anomalous overwrites the old one, even with null."""
    r = results.filter("calibrated").select("asset_id", F.lit(True).alias("_hit"), F.col("travel_rate_lpk").alias("_rate"), F.col("r2").alias("_r2"), F.col("included_count").alias("_n"), F.col("idle_rate_lph").alias("_idle"), F.col("anomalous").alias("_odd"))
    j = assets.join(r, "asset_id", "left")
    hit, odd = F.coalesce("_hit", F.lit(False)), F.coalesce("_odd", F.lit(False))
    new = {
        "travel_rate_lpk": F.when(hit, F.col("_rate")), "travel_rate_r2": F.when(hit, F.col("_r2")), "calibration_interval_count": F.when(hit, F.col("_n").cast("int")), "last_calibrated_at": F.when(hit, now),
        "idle_burn_rate_lph": F.when(hit & ~odd, F.col("_idle")), "idle_anomaly_flagged_at": F.when(hit & odd, now),
    }
    touched = {"idle_burn_rate_lph": hit & ~odd, "idle_anomaly_flagged_at": hit & odd}
    return j.select(*(F.when(touched.get(c, hit), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in assets.columns))


def loo_error(intervals: DataFrame, keys: list[str], class_rate: str | None = None) -> DataFrame:
    """``error_pct`` of each interval when its own row is left out of the asset's slope, in closed form.

    ``class_rate``: a column with the idle rate held fixed (pooled model); without it distance alone predicts.
    Groups with fewer than three rows, and rows without litres, have no error.
    """
    w = Window.partitionBy(*keys)
    idle = F.col(class_rate) * F.col("idle_hours") if class_rate else F.lit(0.0)
    x, y = F.col("distance_km"), F.greatest(F.col("litres") - idle, F.lit(0.0)) if class_rate else F.col("litres")
    sxx = F.sum(x * x).over(w) - x * x
    sxy = F.sum(x * y).over(w) - x * y
    predicted = F.greatest(slope(sxy, sxx), F.lit(0.0)) * x + idle
    usable = (F.count("*").over(w) >= 3) & (F.col("litres") > 0)
    return intervals.withColumn("error_pct", F.when(usable, F.abs(predicted - F.col("litres")) / F.col("litres") * 100))


def loo_median(intervals: DataFrame, keys: list[str], class_rate: str | None = None) -> DataFrame:
    return loo_error(intervals, keys, class_rate).groupBy(*keys).agg(F.percentile("error_pct", F.lit(0.5)).alias("loo_error_pct"))


def centered_r2(rows: DataFrame, keys: list[str], predicted: str, actual: str = "litres") -> DataFrame:
    """1 - residual / spread about the mean; null where nothing varies."""
    g = rows.groupBy(*keys).agg(F.sum(F.pow(F.col(actual) - F.col(predicted), 2)).alias("_res"), (F.var_pop(actual) * F.count(actual)).alias("_tot"))
    return g.select(*keys, F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).alias("r2_centered"))


def eligible_intervals(merged: DataFrame, assets: DataFrame) -> DataFrame:
    """Included intervals of active assets that have enough of them, with account and idle class."""
    inc = merged.filter("included").withColumn("_n", F.count("*").over(Window.partitionBy("asset_id"))).filter(F.col("_n") >= S.MIN_INTERVALS_TO_CALIBRATE).drop("_n")
    a = assets.filter(~F.col("is_ignored")).select("asset_id", "user_id", "asset_name", "travel_rate_lpk", X.idle_class(F.col("asset_name")).alias("idle_class"))
    return inc.join(a, "asset_id")


def asset_terms(intervals: DataFrame) -> DataFrame:
    """Per asset, what a fit needs of its intervals: sums, and for the litres that a class rate leaves over, breakpoints.

    Litres left over at rate r are max(0, litres - r * idle): intervals whose litres an idle hour exceed r count, the others
    give 0. ``at`` has these breakpoints, descending, ``xy`` and ``xi`` the running sums of distance * litres and distance *
    idle in that order, so any rate is a binary search.
    """
    x, y, idle = F.col("distance_km"), F.col("litres"), F.col("idle_hours")
    at = F.when(idle > 0, y / idle).when(y > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    rows = intervals.select("user_id", "asset_id", "idle_class", x, y, idle, at.alias("at"))
    w = Window.partitionBy("asset_id").orderBy(F.desc("at"), "distance_km", "litres").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("at"), "distance_km", "litres")).alias("k"), F.sum(x * y).over(w).alias("xy"), F.sum(x * idle).over(w).alias("xi"))
    g = rows.groupBy("asset_id").agg(
        F.first("user_id").alias("user_id"), F.first("idle_class").alias("idle_class"), F.array_sort(F.collect_list(F.struct("k", "at", "xy", "xi"))).alias("p"),
        F.sum(x * x).alias("sxx"), F.sum(idle * y).alias("siy"), F.sum(idle * x).alias("six"), F.sum(idle * idle).alias("sii"),
    )
    return g.select("user_id", "asset_id", "idle_class", *(F.col(f"p.{c}").alias(c) for c in ("at", "xy", "xi")), "sxx", "siy", "six", "sii")


def left_over(rate: Column) -> Column:
    """The sum of distance * max(0, litres - rate * idle hours) of an asset, from its terms."""
    n = F.size("at")
    # the number of breakpoints above the rate, found by halving steps
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(24))))
    above = F.aggregate(steps, F.lit(0), lambda k, step: F.when((k + step <= n) & (F.element_at("at", F.least(k + step, n)) > rate), k + step).otherwise(k))
    return F.when(above > 0, F.element_at("xy", F.greatest(above, F.lit(1))) - rate * F.element_at("xi", F.greatest(above, F.lit(1)))).otherwise(0.0)


def pooled_fit(intervals: DataFrame, rounds: int = S.POOLED_ROUNDS, tolerance: float = S.POOLED_TOLERANCE, small_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(asset rates: user_id, asset_id, idle_class, travel_rate; class rates: user_id, idle_class, class_rate).

    Intervals are shuffled once, into a row per asset (see asset_terms). Each round refits every asset's travel rate with the
    class rates held, then every class with the travel rates held: it reads those rows and exchanges one partial sum for each
    account and class and task. Up to ``small_rows`` class rates are sent to the assets; beyond, assets are shuffled to them.
    An account whose classes all moved less than ``tolerance`` stays as it is from then on.
    """
    terms = cut(asset_terms(intervals))
    priors = F.array(*(F.struct(F.lit(k).alias("idle_class"), F.lit(prior).alias("class_rate"), F.lit(low).alias("low"), F.lit(high).alias("high")) for k, (prior, low, high) in S.IDLE_CLASSES.items()))
    rates = cut(terms.select("user_id").distinct().select("user_id", F.inline(priors)).withColumn("used", F.col("class_rate")).withColumn("done", F.lit(False)))
    few = rates.count() <= small_rows

    def travel_by(rate: str) -> DataFrame:
        """Every asset's travel rate with the class rates in ``rate`` held, beside the sums that the class rates need."""
        known = rates.select("user_id", "idle_class", F.col(rate).alias("rate"))
        g = terms.join(F.broadcast(known) if few else known, ["user_id", "idle_class"])
        return g.select("user_id", "asset_id", "idle_class", "siy", "six", "sii", F.greatest(slope(left_over(F.col("rate")), F.col("sxx")), F.lit(0.0)).alias("travel_rate"))

    for _ in range(rounds):
        # classes that are done keep the rate they have, so what their assets give them is not looked at
        per_class = travel_by("class_rate").groupBy("user_id", "idle_class").agg(F.sum(F.col("siy") - F.col("travel_rate") * F.col("six")).alias("num"), F.sum("sii").alias("den"))
        j = rates.join(per_class, ["user_id", "idle_class"], "left")
        raw = F.when(F.col("den").isNull(), F.col("class_rate")).otherwise(F.least(F.greatest(slope(F.col("num"), F.col("den")), F.col("low")), F.col("high")))
        j = j.withColumn("_new", F.when(F.col("done"), F.col("class_rate")).otherwise(raw)).withColumn("_used", F.when(F.col("done"), F.col("used")).otherwise(F.col("class_rate")))
        moved = F.max(F.abs(F.col("_new") - F.col("class_rate"))).over(Window.partitionBy("user_id"))
        rates = cut(j.withColumn("done", F.col("done") | (moved < tolerance)).select("user_id", "idle_class", F.col("_new").alias("class_rate"), "low", "high", F.col("_used").alias("used"), "done"))
        if not rates.filter(~F.col("done")).limit(1).count():
            break
    # an asset's rate is the one of its account's last round: with the class rates as they were before it
    return cut(travel_by("used").select("user_id", "asset_id", "idle_class", "travel_rate")), rates.select("user_id", "idle_class", "class_rate")


def compare_models(intervals: DataFrame, merged: DataFrame, assets: DataFrame, fit: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per asset: rates, centred R2 and leave-one-out error of the single and the pooled model, and the account's median errors."""
    travel, classes = fit
    iv = intervals.join(travel.select("asset_id", "travel_rate"), "asset_id").join(classes, ["user_id", "idle_class"])
    old = calibrate_assets(merged, assets).select("asset_id", F.col("travel_rate_lpk").alias("old_travel_rate"), F.col("idle_rate_lph").alias("old_idle_rate"))
    iv = iv.join(old, "asset_id").withColumn("_old", F.col("old_travel_rate") * F.col("distance_km")).withColumn("_new", F.col("travel_rate") * F.col("distance_km") + F.col("class_rate") * F.col("idle_hours"))
    keys = ["user_id", "asset_id"]
    # both errors are windows over one partitioning, and one grouping of the same takes all figures
    iv = loo_error(loo_error(iv, keys).withColumnRenamed("error_pct", "_old_error"), keys, "class_rate").withColumnRenamed("error_pct", "_new_error")
    spread = F.var_pop("litres") * F.count("litres")
    r2 = lambda c: F.when(spread > 0, 1 - F.sum(F.pow(F.col("litres") - F.col(c), 2)) / spread)
    head = iv.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in ("idle_class", "old_travel_rate", "old_idle_rate", "travel_rate", "class_rate")), r2("_old").alias("old_r2"), r2("_new").alias("new_r2"),
        F.percentile("_old_error", F.lit(0.5)).alias("old_loo_pct"), F.percentile("_new_error", F.lit(0.5)).alias("new_loo_pct"),
    )
    fleet = head.groupBy("user_id").agg(F.percentile("old_loo_pct", F.lit(0.5)).alias("account_old_loo_pct"), F.percentile("new_loo_pct", F.lit(0.5)).alias("account_new_loo_pct"))
    return head.join(fleet, "user_id", "left")
