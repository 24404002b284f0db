"""Embedding texts: a default JVM embedder, pluggable functions, reuse and backfill."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import claim_sentence


@dataclass(frozen=True)
class Embedder:
    """Turns the `text` column into `embedding`; `function` maps a list of texts to vectors.

    Without a function the words are hashed and the counts scaled to unit length, all in the JVM.
    """

    name: str = "hashing"
    dimensions: int = 256
    function: Callable[[list[str]], np.ndarray] | None = None

    def embed(self, df: DataFrame) -> DataFrame:
        """Adds embedding and error; a failing batch leaves its rows without an embedding."""
        if self.function is None:
            words = Tokenizer(inputCol="text", outputCol="_words").transform(df.withColumn("text", F.col("text")))
            counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=self.dimensions).transform(words)
            scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
            return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).withColumn(
                "error", F.lit(None).cast("string")
            ).drop("_words", "_counts", "_unit")
        function = self.function

        @F.pandas_udf("struct<embedding:array<float>,error:string>")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    vectors = [np.asarray(v, dtype="float32") for v in function(batch.tolist())]
                    yield pd.DataFrame({"embedding": vectors, "error": [None] * len(batch)})
                except Exception as failure:  # noqa: BLE001 - the row reports it
                    yield pd.DataFrame({"embedding": [None] * len(batch), "error": [str(failure)] * len(batch)})

        done = df.withColumn("_e", apply("text"))
        return done.withColumn("embedding", F.col("_e.embedding")).withColumn("error", F.col("_e.error")).drop("_e")


def content_key(text: str = "text"):
    return F.sha2(F.col(text), 256)


def embed_with_store(rows: DataFrame, store: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Embeds `text`, reusing stored vectors: (rows with embedding and `cached`, new store rows).

    Each distinct unknown text is embedded once, however often it occurs.
    """
    keyed = rows.withColumn("content_key", content_key())
    mine = store.where(F.col("model") == embedder.name)
    missing = keyed.select("content_key", "text").join(mine.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])
    fresh = embedder.embed(missing).where("embedding is not null").select(
        "content_key", "embedding", F.lit(embedder.name).alias("model")
    )
    known = mine.select("content_key", "embedding", F.lit(True).alias("cached")).unionByName(
        fresh.select("content_key", "embedding", F.lit(False).alias("cached"))
    )
    return keyed.join(known, "content_key", "left"), fresh


def backfill_embeddings(claims: DataFrame, embedder: Embedder) -> DataFrame:
    """Canonical claims without an embedding, embedded: (claim_id, embedding, embedding_model, error)."""
    missing = claims.where(F.col("embedding").isNull() & F.col("is_canonical"))
    texts = missing.select("claim_id", claim_sentence("subject", "predicate", "object").alias("text"))
    return embedder.embed(texts).select(
        "claim_id", "embedding", F.when(F.col("error").isNull(), F.lit(embedder.name)).alias("embedding_model"), "error"
    )


def backfill_report(backfilled: DataFrame) -> DataFrame:
    return backfilled.agg(
        F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
