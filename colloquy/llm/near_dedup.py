"""Near duplicates by circulant MinHash.

One permutation orders the shingles, a second one is shifted circularly by k to give coordinate k of
the signature, so two permutations make all coordinates. Bands of ROWS coordinates are buckets; links
are confirmed on full shingle sets; components join the links.

Sizes: texts with the same shingle set are folded first, so a group of copies is one node. A bucket
compares every member with one of them (its hub): one row per member and bucket, never all pairs.
Members that the hub does not confirm are then compared with those members that no bound excludes:
Jaccard distance is a metric, so two sets within 1-s of each other differ by at most 1-s in their
distance from the hub, and they cannot share shingles that only one of them has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, chunks, utf8
from colloquy.llm.shingles import at_least, digest, shingle_sets
from colloquy.operators.graph import connected_components
from colloquy.session import discard, materialize

#: For the usual threshold of 0.8; higher thresholds can take more rows per band.
BANDS, ROWS = 42, 6

#: Multipliers of the second permutation of [0, 2^32): multiply, shift, multiply are bijections.
_P1, _P2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set: coordinate k is the least value of the permutation shifted by k."""
    places = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation: a mixed hash
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    best = np.full(coordinates, np.uint32(0xFFFFFFFF), dtype=np.uint32)
    for start in range(0, len(places), 256):
        x = places[start:start + 256][None, :] + shifts
        x *= _P1
        x ^= x >> np.uint32(15)
        x *= _P2
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number per band."""
    parts = sign.reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        keys = (keys ^ parts[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _signed(words: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [utf8(t) for t in batch["text"]]
            for a, b in chunks([len(t) for t in texts]):
                sets, _ = shingle_sets(texts[a:b], words)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(dtype=object, na_value=None),
                    "text_key": batch["text_key"].iloc[a:b].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [digest(s) if len(s) else None for s in sets],
                    "bands": [band_keys(signature(s, bands * rows), bands, rows) if len(s) else None for s in sets],
                })

    return run


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Adds whether both sides of each pair (a, b) are similar on their full sets, and how much.

    Also size_a, and for pairs that are not far apart what b lacks of a's shingles.
    """
    near = max(0.0, 2 * percent / 100 - 1) - 0.05

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(x) + len(y) for x, y in zip(batch["text_a"], batch["text_b"])]
            for i, j in chunks(sizes):
                part = batch.iloc[i:j]
                both, _ = shingle_sets([utf8(t) for t in [*part["text_a"], *part["text_b"]]], words)
                n = j - i
                found = [at_least(both[k], both[n + k], percent) for k in range(n)]
                yield pd.DataFrame({
                    "a": part["a"].to_numpy(), "b": part["b"].to_numpy(),
                    "linked": [f[0] for f in found], "ratio": [f[1] for f in found],
                    "size_a": [len(both[k]) for k in range(n)],
                    "missing": [
                        np.setdiff1d(both[k], both[n + k], assume_unique=True).view(np.int64) if f[1] >= near else None
                        for k, f in enumerate(found)
                    ],
                })

    # The side with many pairs per text (the hub's) is joined last, so its text is not carried twice.
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.mapInPandas(run, "a long, b long, linked boolean, ratio double, size_a long, missing array<long>")


def _solo_counts(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """How many shingles of each node no other of these nodes has: (member, solo)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [utf8(t) for t in batch["text"]]
            for i, j in chunks([len(t) for t in data]):
                sets, _ = shingle_sets(data[i:j], words)
                yield pd.DataFrame({
                    "member": np.repeat(batch["node"].iloc[i:j].to_numpy(), [len(s) for s in sets]),
                    "shingle": np.concatenate(sets).view(np.int64),
                })

    own = texts.join(nodes.select(F.col("member").alias("node")).distinct(), "node").select("node", "text")
    seen = own.mapInPandas(run, "member long, shingle long")
    once = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("member")).where("n = 1")
    return once.groupBy("member").agg(F.count(F.lit(1)).alias("solo"))


def _within_reach(compared: DataFrame, linked: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket that its hub has not settled and that may still be linked.

    One of the two is out of the hub's reach, no links join them yet, and no bound rules them out: sizes;
    the metric; and what they can share. Of the hub's shingles they share those that neither lacks; of
    others at most those that each has in common with anyone. If one is far from the hub, they share at
    most what either has in common with anyone.
    """
    strays = compared.where("not linked").select("bucket").distinct()
    open_rows = compared.join(strays, "bucket")
    members = open_rows.select(F.explode(F.array("member", "hub")).alias("member")).distinct()
    joined = connected_components(members.select(F.col("member").alias("id")), linked)
    facts = materialize(
        members.join(joined.select(F.col("id").alias("member"), "component"), "member")
        .join(_solo_counts(members, texts, words), "member", "left")
        .select("member", "component", F.coalesce("solo", F.lit(0)).alias("solo"))
    )
    rows = materialize(open_rows.join(facts, "member").withColumn("common", F.col("size") - F.col("solo")))
    facts_of = ("member", "size", "d", "component", "common", "missing", "linked")
    a = rows.select("bucket", "hub_size", *[F.col(c).alias(f"{c}_a") for c in facts_of])
    b = rows.where("not linked").select("bucket", *[F.col(c).alias(f"{c}_b") for c in facts_of])
    lacking = F.size("missing_a") + F.size("missing_b") - F.size(F.array_intersect("missing_a", "missing_b"))
    others = [F.col(f"common_{x}") - (F.col("hub_size") - F.size(f"missing_{x}")) for x in "ab"]
    shared = F.when(
        F.col("missing_a").isNotNull() & F.col("missing_b").isNotNull(), F.col("hub_size") - lacking + F.least(*others)
    ).otherwise(F.least("common_a", "common_b"))
    return (
        b.join(a, "bucket")
        .where(
            (F.col("linked_a") | (F.col("member_a") < F.col("member_b")))
            & (F.col("component_a") != F.col("component_b"))
            & (F.abs(F.col("d_a") - F.col("d_b")) <= 1 - percent / 100 + 1e-9)
            & (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
            & ((100 + percent) * shared >= percent * (F.col("size_a") + F.col("size_b")))
        )
        .select(F.col("member_a").alias("a"), F.col("member_b").alias("b")).distinct()
    )


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Components of near-duplicate texts: (doc_id, text_key, n_shingles, component_id, kept, component).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets
    (`words` words; a text with fewer has one shingle, all its words). component_id is the smallest
    doc_id that links reach, kept says that it is the own one. A null or empty text has no shingles and
    is linked with nothing. Every row is judged by its own text: rows that repeat a doc_id with texts that are
    unlike each other are in components of their own, which may then have one component_id; `component`, a
    number that is unique within a run, tells them apart (null without shingles). A row without a doc_id has
    component null and is kept. An empty table gives no rows. Only doc_id and text are read, so other columns
    may have any name.

    A pair at similarity s is missed with probability (1 - s^rows)^bands: 3e-6 at 0.8 with 42 bands of
    6, 1e-6 at 0.85 with 36 bands of 7.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("text_key", text_key(F.col("text")))
    signed = materialize(
        source.mapInPandas(
            _signed(words, bands, rows),
            "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>",
        )
    )
    # One node per distinct set; the text of one of its rows, the one with the smallest id, stands for it.
    told = signed.where("doc_id is not null and set_key is not null")
    classes = materialize(
        told.groupBy("set_key").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"),
        ).select(F.monotonically_increasing_id().alias("node"), "set_key", "first.*", "size", "bands")
    )
    keyed = classes.select(F.col("node").alias("member"), "size", F.explode("bands").alias("bucket"))
    crowds = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    crowded = materialize(keyed.join(crowds, "bucket"))
    # The hub of a bucket is the member with most company over all its buckets: an original has more
    # copies around it than any of its copies has.
    company = crowded.groupBy("member").agg(F.sum("members").alias("company"))
    hubs = materialize(
        crowded.join(company, "member").groupBy("bucket")
        .agg(F.max_by("member", F.struct("company", -F.col("member"))).alias("hub"))
    )
    placed = materialize(crowded.join(hubs, "bucket").select("member", "size", "bucket", "hub"))
    pairs = placed.where("member <> hub").select(F.col("hub").alias("a"), F.col("member").alias("b")).distinct()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Texts of the compared sets only; one row per node even where rows repeat an id and its text.
    chosen = classes.select("node", "doc_id", "text_key").join(needed, "node")
    texts = materialize(source.join(chosen, ["doc_id", "text_key"]).groupBy("node").agg(F.first("text").alias("text")))
    tested = materialize(_verify(pairs, texts, words, percent))

    linked = tested.where("linked").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    compared = placed.where("member <> hub").join(
        tested.select(
            F.col("a").alias("hub"), F.col("b").alias("member"), "linked", (1 - F.col("ratio")).alias("d"),
            F.col("size_a").alias("hub_size"), "missing",
        ),
        ["hub", "member"],
    )
    compared = materialize(compared.select("bucket", "hub", "member", "size", "linked", "d", "hub_size", "missing"))
    more = materialize(_verify(_within_reach(compared, linked, texts, words, percent), texts, words, percent))
    links = linked.unionByName(more.where("linked").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))
    labels = connected_components(classes.select(F.col("node").alias("id")), links)
    labelled = materialize(
        classes.select(F.col("node").alias("id"), "set_key", "doc_id").join(labels, "id").select("set_key", "doc_id", "component")
    )
    discard(crowds, crowded, hubs, placed, texts, tested, compared, more)
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(labelled.join(smallest, "component").select("set_key", "component", "component_id"))
    # Rows without shingles meet nothing; they would all be one key of the join.
    found = told.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key").drop("set_key")
    alone = signed.where("doc_id is null or set_key is null").select(
        "doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone).select(
        "doc_id", "text_key", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "component",
    )
