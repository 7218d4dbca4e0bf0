"""Relational operators that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending order; an aggregate, so a hot key shrinks in every task before it meets."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__first")).select(*key, "__first.*").select(df.columns)


def prefix(df: DataFrame, groups: list[str], order: list[str | Column], bucket: Column, value: Column, into: str, total: str | None = None) -> DataFrame:
    """``into``: the sum of ``value`` over the rows of the group before each row; ``total``: over all of the group.

    In two levels, so that no task orders a whole group: ``bucket`` is a
    number that rises with the order; sums of whole buckets are added up
    first, then rows inside their bucket.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    sums = rows.groupBy(*groups, "__bucket").agg(F.sum("__value").alias("__sum"))
    every = Window.partitionBy(*groups)
    base = F.coalesce(F.sum("__sum").over(every.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*groups, "__bucket"]
    sums = sums.select(*(F.col(k).alias(f"__of_{k}") for k in keys), base.alias("__base"), F.sum("__sum").over(every).alias("__total"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(sums[f"__of_{k}"])
    extra = [F.col("__total").alias(total)] if total else []
    return rows.join(sums, same).select(*df.columns, (F.col("__base") + F.col("__inside")).alias(into), *extra)


def by_value(column: str, width: int = 65536) -> Column:
    """Buckets of a number that rows are ordered by."""
    return F.floor(F.col(column) / width)


def by_digits(column: str, digits: int = 4) -> Column:
    """Buckets of a string of hex digits that rows are ordered by."""
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("long")


def bottom_k(df: DataFrame, groups: list[str], order: list[str | Column], k: int | Column) -> DataFrame:
    """The k first rows of each group; ranks are cut within tasks before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unique_lookup(df: DataFrame, key: list[str], value: str, conflict: str = "unknown") -> DataFrame:
    """One row for each key: its value if all rows agree, else ``conflict``."""
    agreed = F.when(F.countDistinct(value) == 1, F.min(value)).otherwise(F.lit(conflict))
    return df.groupBy(*key).agg(agreed.alias(value))


def differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of ``new`` that ``old`` lacks or holds with other values."""
    o = old.select(key, F.struct(*columns).alias("__old"))
    n = new.select(key, F.struct(*columns).alias("__new"))
    state = F.when(F.col("__old").isNull(), "added").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return n.join(o, key, "left").withColumn("state", state).where("state is not null").select(key, "state")


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the interval [low, high) that holds them, by equal buckets of ``width`` instead of a nested loop."""
    buckets = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    wide = intervals.where(F.col(high) > F.col(low)).withColumn("__bucket", F.explode(buckets))
    return points.withColumn("__bucket", F.floor(F.col(point) / width)).join(wide, "__bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bucket")


def islands(df: DataFrame, partition: list[str], order: list[str], starts: Column, into: str = "island") -> DataFrame:
    """Numbers the runs of rows; ``starts`` says where a run begins."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__start", starts.cast("int")).withColumn(into, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")
