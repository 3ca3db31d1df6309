"""Ordered operators over groups of any size: a group is cut into ranges of its position, each range is one window
partition, and what a range needs from the others is carried by a window over one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions a range spans, unless a caller says otherwise.
WIDTH = 1_000_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over as many partitions as the session shuffles into. Where a small row stands for much work, as
    a region does, adaptive execution would put all of them into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_ranges(rows: DataFrame, position: str, width: int = WIDTH) -> DataFrame:
    return rows.withColumn("__lf_range", F.floor(F.col(position) / F.lit(width)))


def running_sum(rows: DataFrame, group: str, position: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the sum of value over the group's rows up to and with their position (ties share it)."""
    rows = in_ranges(rows, position, width)
    sums = rows.groupBy(group, "__lf_range").agg(F.sum(value).alias("__lf_sum"))
    ahead = Window.partitionBy(group).orderBy("__lf_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__lf_range", F.coalesce(F.sum("__lf_sum").over(ahead), F.lit(0)).alias("__lf_base"))
    own = F.sum(value).over(Window.partitionBy(group, "__lf_range").orderBy(position))
    return rows.withColumn(name, own).join(sums, [group, "__lf_range"]).withColumn(name, F.col("__lf_base") + F.col(name)).drop("__lf_range", "__lf_base")


def with_neighbours(rows: DataFrame, group: str, order: list[Column], position: str, value: Column, width: int = WIDTH, strict: bool = False) -> DataFrame:
    """rows with `before` and `after`: the nearest value that isn't null at or before, and at or after a row in the
    order of its group; with `strict`, before or after it."""
    rows = in_ranges(rows, position, width).withColumn("__lf_value", value)
    by = Window.partitionBy(group, "__lf_range").orderBy(*order)
    back = Window.partitionBy(group, "__lf_range").orderBy(*[c.desc() for c in order])
    until = -1 if strict else 0
    last = lambda w: F.last("__lf_value", True).over(w.rowsBetween(Window.unboundedPreceding, until))
    marked = rows.withColumns({"before": last(by), "after": last(back)})
    # the first and last value of each range, in the same order
    key = F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)])
    ends = rows.where("__lf_value IS NOT NULL").groupBy(group, "__lf_range").agg(F.min_by("__lf_value", key).alias("low"), F.max_by("__lf_value", key).alias("high"))
    ends = rows.select(group, "__lf_range").distinct().join(ends, [group, "__lf_range"], "left")
    across, beyond = Window.partitionBy(group).orderBy("__lf_range"), Window.partitionBy(group).orderBy(F.desc("__lf_range"))
    carried = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(group, "__lf_range", carried("high", across).alias("__lf_low"), carried("low", beyond).alias("__lf_high"))
    out = marked.join(ends, [group, "__lf_range"])
    return out.withColumns({"before": F.coalesce("before", "__lf_low"), "after": F.coalesce("after", "__lf_high")}).drop("__lf_range", "__lf_value", "__lf_low", "__lf_high")


def numbered(rows: DataFrame, group: str, position: str, order: list[Column], name: str, width: int = WIDTH) -> DataFrame:
    """rows with their number, from 0, in the order of their group; the order begins with the position."""
    rows = in_ranges(rows, position, width)
    counts = rows.groupBy(group, "__lf_range").agg(F.count(F.lit(1)).alias("__lf_n"))
    ahead = Window.partitionBy(group).orderBy("__lf_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__lf_range", F.coalesce(F.sum("__lf_n").over(ahead), F.lit(0)).alias("__lf_start"))
    own = F.row_number().over(Window.partitionBy(group, "__lf_range").orderBy(*order))
    out = rows.withColumn(name, own).join(starts, [group, "__lf_range"])
    return out.withColumn(name, (F.col(name) + F.col("__lf_start") - 1).cast("long")).drop("__lf_range", "__lf_start")
