"""Running values over groups of any size: rows are dealt by range of the order, so a large group spans many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon.llm.common import join_on, save


def deal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Save `df` in range partitions of `order`, with `_part` (the partition) and `_tie` (parts equal rows)."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie")
    return save(rows.withColumn("_part", F.spark_partition_id()), name)


def running_sum(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group that come before; `order` starts with what it was dealt by."""
    inside = Window.partitionBy("_part", *keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", *keys).agg(F.sum(value).alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *keys, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    rows = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return join_on(rows, starts, ["_part", *keys]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def last_before(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last `value` that is not null up to and including the row, within the group."""
    inside = Window.partitionBy("_part", *keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order, "_tie")
    parts = dealt.filter(F.col(value).isNotNull()).groupBy("_part", *keys).agg(F.max_by(value, place).alias("_last"))
    every = dealt.select("_part", *keys).distinct()
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = join_on(every, parts, ["_part", *keys], "left").select("_part", *keys, F.last("_last", True).over(before).alias("_carried"))
    rows = dealt.withColumn("_own", F.last(value, True).over(inside))
    return join_on(rows, carried, ["_part", *keys]).withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried")
