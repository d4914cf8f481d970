"""Running sums that spread over tasks also where one key has most of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, out: str, range_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of ``key`` so far, by ``order``, which tells a key's rows apart.

    Rows are split by range of key and order, each range is summed by itself, and what a key has in earlier ranges, one number
    for each range it is in, is added. Nothing but those numbers depends on how many rows a key has.
    """
    ranges = math.ceil(rows.count() / range_rows) or 1
    placed = cut(rows.repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range", key).agg(F.sum(value).alias("_sum"))
    carried = sums.withColumn("_carried", F.sum("_sum").over(before)).filter("_carried IS NOT NULL").drop("_sum")
    own = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_own", F.sum(value).over(own)).join(carried, ["_range", key], "left")
    return summed.withColumn(out, F.col("_own") + F.coalesce("_carried", F.lit(0.0))).select(*rows.columns, out)
