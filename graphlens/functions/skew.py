"""Joins and running totals that keep working when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import cut

HOT_ROWS = 1_000_000


def split_hot_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    spread_right: Column | None = None,
) -> DataFrame:
    """Inner equi join whose hot keys on the left are cut into slices; with `spread_right`, on both sides.

    A key with more than `hot_rows` rows on the left gets ceil(rows / hot_rows)
    slices and its right rows are repeated once per slice; all other keys stay
    in one. At most (left rows / hot_rows) keys can be hot, which bounds the
    table that is broadcast. `spread_by` decides the slice, so it must be a
    column that differs between the rows of one key. `counted` is a table with at
    least as many rows per key as `left`, where one is at hand that is cheaper to
    count; the slices then follow its counts.

    With `spread_right`, a column that differs between the right rows of a key, a key
    that is hot on either side becomes a grid: its left rows fall into rows of it, its
    right rows into columns, each repeated along the other way, so every cell joins
    at most about `hot_rows` rows with as many. Keys that are hot are counted on both
    sides, and are at most (left + right rows / hot_rows).
    """
    if spread_right is not None:
        return _grid_join(left, right, keys, spread_by, spread_right, hot_rows, left if counted is None else counted)
    hot = (
        (left if counted is None else counted).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices"))
    )
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    sliced = (
        left.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int"))
        .drop("_slices")
    )
    repeated = (
        right.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return sliced.join(repeated, [*keys, "_slice"]).drop("_slice")


def _grid_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_left: Column, spread_right: Column, hot_rows: int, counted: DataFrame
) -> DataFrame:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = counted.select(*keys, one.alias("_l"), none.alias("_r")).unionByName(right.select(*keys, none.alias("_l"), one.alias("_r")))
    hot = (
        rows.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).filter((F.col("_l") > hot_rows) | (F.col("_r") > hot_rows))
        .select(*keys, *[F.greatest(F.ceil(F.col(c) / hot_rows), F.lit(1)).cast("int").alias(c) for c in ("_l", "_r")])
    )
    down, across = F.coalesce(F.col("_l"), F.lit(1)), F.coalesce(F.col("_r"), F.lit(1))
    place = lambda by, n: F.pmod(F.xxhash64(by), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    met = lambda df: df.join(F.broadcast(hot), list(keys), "left")
    sliced = met(left).withColumn("_row", place(spread_left, down)).withColumn("_column", every(across)).drop("_l", "_r")
    other = met(right).withColumn("_column", place(spread_right, across)).withColumn("_row", every(down)).drop("_l", "_r")
    # a side that looks small on disk is not sent to the driver
    return sliced.join(other.hint("merge"), [*keys, "_row", "_column"]).drop("_row", "_column")


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add the sum of `value` over the earlier rows of the group.

    A plain window sends a whole group to one task. Here rows are ranged over
    (group, order), each slice sums its own rows, and the totals of the earlier
    slices of the group, one row per slice, are added on top.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(n, *group, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_value", value)
    )
    inside = (
        Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "_slice")
        .agg(F.sum("_value").alias("_sum"))
        .select(*group, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    )
    return (
        ranged.join(offsets, [*group, "_slice"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_slice", "_value", "_base")
    )
