"""Stored feed listings to post rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = "title string, link struct<_href:string>, author struct<name:string>, updated string"


def valid_subreddit(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_]{2,20}$")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed files, one row per entry; Spark splits large files by entry."""
    return entries_to_posts(spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path))


def parse_feed_column(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Entries held as XML strings in a column."""
    return entries_to_posts(df.select(*keep, F.from_xml(xml, ENTRY_SCHEMA).alias("e")).select(*keep, "e.*"), keep)


def entries_to_posts(entries: DataFrame, keep: list[str] = []) -> DataFrame:
    link = F.coalesce("link._href", F.lit(""))
    path = F.try_parse_url(link, F.lit("PATH"))
    trimmed = F.regexp_extract(path, r"(?i)(/r/[a-zA-Z0-9_]+/comments/[a-z0-9]+)/", 1)
    permalink = F.when(path.isNull(), link).when(trimmed != "", F.concat(trimmed, F.lit("/"))).otherwise(path)
    rows = entries.select(
        *keep,
        F.coalesce("title", F.lit("")).alias("title"), link.alias("link"), permalink.alias("permalink"),
        F.coalesce(F.regexp_replace("author.name", "^/u/", ""), F.lit("unknown")).alias("author"),
        F.try_to_timestamp("updated").alias("published_at"),
        F.regexp_extract(link, r"/r/([a-zA-Z0-9_]+)/", 1).alias("subreddit"),
    )
    rows = rows.withColumn("post_id", F.regexp_extract("permalink", r"(?i)/comments/([a-z0-9]+)/", 1))
    return rows.where(F.col("post_id") != "")
