"""Ranks and offsets inside groups of any size.

A window over one group is one task.  Where a group may be huge, the order is
cut into buckets that follow it: ranks are taken per bucket, and a window over
the bucket COUNTS (one row per bucket) supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldrecon.session import cut_lineage


def offsets(df: DataFrame, keys: list[str], buckets: list[str], value, name: str) -> DataFrame:
    """Per (keys, bucket): the sum of `value` over all earlier buckets of the key."""
    sums = df.groupBy(*keys, *buckets).agg(value.alias("_v"))
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, *buckets, F.coalesce(F.sum("_v").over(before), F.lit(0)).alias(name))


def rank_in_groups(df: DataFrame, keys: list[str], buckets: list[str], order: list, name: str) -> DataFrame:
    """row_number over (keys ordered by buckets, order), exact, no whole-group task.

    `buckets` must be monotone in the wanted order; they are compared first.
    """
    start = offsets(df, keys, buckets, F.count("*"), "_start")
    local = Window.partitionBy(*keys, *buckets).orderBy(*order)
    ranked = df.withColumn("_local", F.row_number().over(local))
    on = [F.col("l." + c).eqNullSafe(F.col("r." + c)) for c in [*keys, *buckets]]
    joined = ranked.alias("l").join(start.alias("r"), on, "left")
    return joined.select(*[F.col("l." + c) for c in df.columns], (F.col("_start") + F.col("_local")).alias(name))


def first_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Value of the first row of each key in the given order."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_writer_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Value of the last row of each key: what repeated assignment leaves behind."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """First n rows of each group; Spark prunes to n per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


#: rows of a range: ranges are as many as the rows need, whatever the session's settings
RANGE = 250_000


def deal(df: DataFrame, order: list[str], size: int = RANGE) -> DataFrame:
    """`df` in ranges of `order` with their number `_part`: a large group spans many tasks.

    Written once, as borders come from a sample.  A range holds about `size` rows; small
    tables are dealt as the session sets it.
    """
    kept = cut_lineage(df)
    parts = -(-kept.count() // size)
    if parts <= df.sparkSession.sparkContext.defaultParallelism:
        ranges = kept.repartitionByRange(*order)
    else:
        ranges = kept.repartitionByRange(parts, *order)
    return cut_lineage(ranges.withColumn("_part", F.spark_partition_id()))


def gather(dealt: DataFrame, size: int = RANGE) -> DataFrame:
    """Each range of `dealt` in one task, for windows within ranges; a task holds a few ranges."""
    parts = -(-dealt.count() // size)
    if parts <= dealt.sparkSession.sparkContext.defaultParallelism:
        return dealt.repartition("_part")
    return dealt.repartition(parts, "_part")


# Ranges follow the order of (keys, order), so only the last group of a range may go on in the next one:
# what is carried over a border is one row for each range, joined by broadcast.
def _carried(ends: DataFrame, keys: list[str], value, step) -> DataFrame:
    """_part, _keys, _carried of the range beside each range; `ends` has _part, _keys and what `value` reads."""
    beside = Window.orderBy("_part")
    return ends.withColumn("_value", value).select(
        "_part", step("_keys").over(beside).alias("_keys"), step("_value").over(beside).alias("_carried")
    )


def _with_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `_carried`, NULL where the group does not go on over the border."""
    out = rows.join(F.broadcast(carried), "_part", "left")
    same = F.struct(*keys).eqNullSafe(F.col("_keys"))
    return out.withColumn("_carried", F.when(same, F.col("_carried"))).drop("_keys")


def _last_groups(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the last group of each range, with `_keys`."""
    last = dealt.groupBy("_part").agg(F.max(F.struct(*keys)).alias("_keys"))
    return dealt.join(F.broadcast(last), "_part").filter(F.struct(*keys).eqNullSafe(F.col("_keys")))


def previous(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`value` of the row before in the group, carried over the borders of ranges; NULL at the start of a group.  No `value` may be NULL."""
    return _neighbour(dealt, keys, order, value, name, F.lag, F.max_by)


def following(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`value` of the row after in the group, carried like `previous`; NULL at the end of a group."""
    return _neighbour(dealt, keys, order, value, name, F.lead, F.min_by)


def _neighbour(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str, step, border) -> DataFrame:
    """`border` picks the row of a range that the range beside it sees, `step` goes one row or one range that way."""
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    end = border(F.struct(F.struct(*keys).alias("_keys"), F.col(value).alias("_end")), F.struct(*keys, *order))
    ends = dealt.groupBy("_part").agg(end.alias("_e")).select("_part", "_e.*")
    rows = gather(dealt).withColumn("_own", step(value).over(inside))
    rows = _with_carried(rows, _carried(ends, keys, F.col("_end"), step), keys)
    return rows.withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried")


def carried_down(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last `value` that is not NULL up to and including the row, carried over the borders of ranges."""
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = _last_groups(dealt, keys).groupBy("_part", "_keys").agg(F.max_by(value, at).alias("_end"))
    so_far = Window.partitionBy("_keys").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    rows = gather(dealt).withColumn("_own", F.last(value, True).over(inside))
    rows = _with_carried(rows, _carried(ends, keys, F.last("_end", True).over(so_far), F.lag), keys)
    return rows.withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried")


def running_total(dealt: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of `value` up to and including the row, within the group.  `dealt` may hold what `previous` and the like gave."""
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = _last_groups(dealt, keys).groupBy("_part", "_keys").agg(F.sum(value).alias("_end"))
    so_far = Window.partitionBy("_keys").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("_inside", F.sum(value).over(inside))
    rows = _with_carried(rows, _carried(ends, keys, F.sum("_end").over(so_far), F.lag), keys)
    return rows.withColumn(name, F.coalesce("_carried", F.lit(0)) + F.col("_inside")).drop("_carried", "_inside")
