"""Ranks and running sums within a key that may hold most of all rows: no key is ever one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def running(rows: DataFrame, key: str, value: str, *order: Column | str) -> DataFrame:
    """rows with k (place from 1 within the key, in the order given), total (sum of value so far), n and whole (of the key).

    Rows are dealt to ranges of (key, order); places and sums are made within a range and moved by what the ranges
    before it hold, which is one row for each. The ranges are checkpointed, as places must not change on a second run.
    """
    placed = checkpointed(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy(key, "_range").orderBy(*order)
    local = placed.withColumns({"k": F.row_number().over(within), "total": F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    sizes = placed.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before, every = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    moved = sizes.select(
        key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_k"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_t"), F.sum("_n").over(every).alias("n"), F.sum("_s").over(every).alias("whole")
    )
    both = local.join(moved, [key, "_range"])
    return both.withColumns({"k": F.col("k") + F.col("_k"), "total": F.col("total") + F.col("_t")}).drop("_range", "_k", "_t")
