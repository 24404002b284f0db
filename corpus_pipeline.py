"""The corpus pipeline: stages over `documents`, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns the columns of docs, but the last, which adds what
the mix takes. Null and empty texts, repeated rows, rows without an id and empty tables pass through as
the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, mixing, near_dedup, pii, quality
from colloquy.llm.common import small_side
from colloquy.session import materialize, read_table

#: Documents that score below are rejected.
LEAST_QUALITY = 0.3
MIX_KEY = "mix"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below LEAST_QUALITY."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    # Packed, so that no column of docs can have the name of a score.
    packed = docs.select("text", F.struct("*").alias("row"))
    scored = quality.score(packed, model, name="quality")
    return scored.where(F.col("quality") >= LEAST_QUALITY).select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Of rows that agree in id and text one stays, and of rows with one id whose texts are near copies or
    without words the one with the smallest text key. Rows that repeat an id with different texts are judged
    each by its own; rows without an id stay.
    """
    texts = materialize(
        near_dedup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id", "text_key")
        .agg(F.first("kept").alias("kept"), F.first("component").alias("component"), F.count(F.lit(1)).alias("rows"))
    )
    winners = texts.where("kept").groupBy("doc_id", "component").agg(F.min(F.struct("text_key", "rows")).alias("first"))
    winners = materialize(winners.select("doc_id", "first.*"))
    gone = small_side(texts.select("doc_id", "text_key").join(winners, ["doc_id", "text_key"], "left_anti"))
    repeated = small_side(winners.where("rows > 1").select("doc_id", "text_key"))
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), near_dedup.text_key(F.col("text")).alias("text_key"),
        F.struct("*").alias("row"),
    )
    left = packed.join(gone, ["doc_id", "text_key"], "left_anti")
    single = left.join(repeated, ["doc_id", "text_key"], "left_anti").select("row")
    one_each = left.join(repeated, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")
    )
    return single.unionByName(one_each.select("row")).select("row.*")


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    clean = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return clean.select(*docs.columns)


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the text."""
    hidden = pii.replace_entities(docs)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hidden.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    Rows that agree in id and text share the words taken from them evenly.
    """
    added = ["size", "source_size", "target", "taken"]
    mixed = mixing.mix(docs, key=MIX_KEY).groupBy("shuffle_place").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.floor(F.sum("taken") / F.count(F.lit(1))).alias("taken"),
    )
    plain = docs.select(*[c for c in docs.columns if c not in added]).withColumn(
        "shuffle_place", mixing.shuffle_place(F.col("doc_id"), F.col("text").cast("string"), MIX_KEY)
    )
    return plain.join(mixed.where("taken > 0"), "shuffle_place").drop("shuffle_place")


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_distinct),
    ("benchmark decontamination", drop_test_items),
    ("private data", hide_private_data),
    ("source mix", mix_sources),
]

# Training and hashing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
