"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import discard, materialize


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels every node with the smallest id of its component: (id, component).

    `nodes` has `id`; `edges` has `id_a`, `id_b` in any direction. State is linear in the edges and
    every round checkpoints, so neither lineage nor memory grows. It ends when a round changes nothing.
    """
    pairs = materialize(
        edges.select(F.least("id_a", "id_b").alias("low"), F.greatest("id_a", "id_b").alias("high"))
        .where("low <> high").distinct()
    )
    before = _signature(pairs)
    while True:
        earlier, (large, smallest) = pairs, _large_star(pairs)
        pairs = materialize(_small_star(large))
        after = _signature(pairs)
        discard(earlier, smallest)
        if after == before:
            break
        before = after
    labels = pairs.select(F.col("high").alias("id"), F.col("low").alias("component"))
    return nodes.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _signature(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h"),
    ).head()
    return row["n"], row["h"]


def _large_star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is tied to the smallest node of the neighbourhood.

    Also returns the written table of smallest nodes, to be discarded after use.
    """
    both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
        pairs.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    # Written first: a join of two plain scans lets the engine split the neighbours of a hub.
    smallest = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = both.join(smallest, "u").where("v > u")
    return joined.select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct(), smallest


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    smallest = pairs.groupBy("high").agg(F.min("low").alias("m"))
    joined = pairs.join(smallest, "high")
    moved = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).where("low <> high")
    own = smallest.select(F.col("m").alias("low"), "high")
    return moved.unionByName(own).distinct()
