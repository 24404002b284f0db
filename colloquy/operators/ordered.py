"""Running totals and row numbers over groups of any size.

A window over one hot key would sort that key in a single task. Here rows are range-partitioned by
(keys, order), each partition sums its own stretch, and the totals of earlier stretches are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import materialize, shuffle_partitions


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    into: str,
) -> DataFrame:
    """Adds `into`: the sum of `value` over the rows of the same keys that come before this row.

    `order` must be unique within a key.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(
        shuffle_partitions(df.sparkSession), *[F.col(k) for k in keys], *order
    )
    # The partition number is only stable once the shuffle is written down.
    ranged = materialize(ranged.withColumn("_stretch", F.spark_partition_id()))
    local = Window.partitionBy("_stretch", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_stretch", *keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    return (
        ranged.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
        .join(offsets, ["_stretch", *keys])
        .withColumn(into, F.col("_local") + F.col("_offset"))
        .drop("_value", "_stretch", "_local", "_offset")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str) -> DataFrame:
    """Adds the one-based position of each row within its keys."""
    counted = running_total(df, keys, order, F.lit(1).cast("bigint"), into)
    return counted.withColumn(into, F.col(into) + 1)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, into: str = "rank"
) -> DataFrame:
    """First n rows per key. Spark limits each map-side partition to n rows per key beforehand."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(into, F.row_number().over(window)).where(F.col(into) <= n)
