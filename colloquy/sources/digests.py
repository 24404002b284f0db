"""Digest dates and the markdown sink."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.ordered import running_total
from colloquy.operators.upsert import current_run, finish_version
from colloquy.session import materialize, shuffle_partitions

ORDER = ["section", "grp", "ord", "part"]


def digest_range(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every day from first to last, so that one job covers the whole range."""
    if first > last:
        raise ValueError("the range ends before it starts")
    days = F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(days).alias("digest_date"))


def write_digests(fragments: DataFrame, path: str) -> None:
    """One folder per date whose files, read in name order, are the document.

    Fragments are range-partitioned and sorted, so a date of any size is written by as many tasks
    as it needs and nothing is collected. The line end of a fragment is left to the text sink.
    `publish_digests` writes them as a version that readers see whole or not at all.
    """
    keys = ["digest_date", *ORDER]
    ordered = fragments.repartitionByRange(shuffle_partitions(fragments.sparkSession), *keys).sortWithinPartitions(*keys)
    line = F.regexp_replace("markdown", r"\n\z", "")
    ordered.select("digest_date", line.alias("value")).write.mode("overwrite").partitionBy("digest_date").text(path)


def publish_digests(fragments: DataFrame, path: str, run_id: str) -> None:
    """Writes the documents as the version `run_id` and then points to it.

    Readers keep the version before until the pointer stands, so a failed run leaves nothing half written
    in sight; a repeated run writes its own folder again.
    """
    write_digests(fragments, f"{path}/run_id={run_id}")
    finish_version(fragments.sparkSession, path, run_id)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the published documents: (digest_date, line_no, line), from 1 on.

    One task reads a block of a file from its start to its end, so the number of a line is its place in the
    block behind the lines of the blocks before; only the blocks are put in order, and no line is moved.
    """
    folder = f"{path}/run_id={current_run(spark, path)}"
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        F.col("digest_date").cast("date").alias("digest_date"), F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        # Rises by one from line to line of a block.
        F.monotonically_increasing_id().alias("place"),
    )
    lines, block = materialize(lines), ["digest_date", "file", "block"]
    blocks = lines.groupBy(*block).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines"))
    blocks = running_total(blocks, ["digest_date"], [F.col("file"), F.col("block")], F.col("lines"), "before")
    found = lines.join(F.broadcast(blocks.select(*block, "first", "before")), block)
    return found.select("digest_date", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_no"), "line")
