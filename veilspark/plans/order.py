"""Places in an order, where one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_key_join(rows: DataFrame, each: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of each, which has one row for each of the keys' values; null keys meet null ones."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return rows.alias("l").join(each.alias("r"), on, "left").select("l.*", *[f"r.{c}" for c in each.columns if c not in keys])


def numbered_within(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with `name`: the place of each, from 1, among the rows that are alike in `by`, in the given order.

    Rows are dealt out by ranges of group and order, so a large group lies over several ranges. Places are counted inside
    a range, and what a group has in the ranges before comes from a row for each group and range."""
    ranged = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    keys = ["_range", *by]
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_in_range", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return same_key_join(placed, offsets, keys).withColumn(name, F.col("_before") + F.col("_in_range")).drop("_range", "_in_range", "_before")
