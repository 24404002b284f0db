"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import bound_batches, materialize  # noqa: F401 - the operators take it from here

#: Rows of a small side that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of text that a Python task handles at a time, whatever the Arrow batch holds.
CHUNK_BYTES = 1 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def utf8(text: str | None) -> bytes:
    """Bytes of a text; null is empty, lone surrogates cannot come from Spark."""
    return b"" if text is None else text.encode("utf-8")


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about `limit` (one row at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, so that every engine agrees."""
    return F.translate(text, UPPER_LETTERS, LOWER_LETTERS)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, written once, with a broadcast hint if its counted rows are within the bound.

    Only narrow tables (ids, hashes, counts) are passed here, so the row bound is a size bound.
    """
    table = materialize(df)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def running_total(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, name: str
) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group that stand before this one.

    The order is (bucket, order). Sums of buckets are added up first, then each bucket alone, so no
    task holds a whole group however large it is. `group` and `bucket` columns must not be null.
    """
    from pyspark.sql import Window

    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_start")
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    return within.join(starts, [*group, bucket]).withColumn(name, F.col("_start") + F.col("_within")).drop(
        "_start", "_within"
    )
