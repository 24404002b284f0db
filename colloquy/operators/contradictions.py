"""Contradictions between claims: joins on structural keys, similarity within a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import predicates as P
from colloquy.functions.text import claim_sentence
from colloquy.operators.bucket_table import BucketTable
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan, keyed_block_join, same_key, unit_vectors
from colloquy.session import materialize

TRIPLE = ["subject", "predicate", "object"]

#: For a list of sentence pairs: whether each is a contradiction, how surely, and why.
Verifier = Callable[[list[tuple[str, str]]], list[tuple[bool, float, str]]]


def _sides(claims: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    cols = ["claim_id", *TRIPLE, *extra]
    left = claims.select(*[F.col(c).alias(f"{c}_1") for c in cols])
    right = claims.select(*[F.col(c).alias(f"{c}_2") for c in cols])
    return left, right


def _typed(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.withColumn("contradiction_type", F.lit(kind)).withColumn(
        "confidence", F.lit(vocab.CONTRADICTION_CONFIDENCE[kind])
    )


def direct_pairs(claims: DataFrame, extra: list[str] = []) -> DataFrame:
    """Same subject and object, opposite predicates.

    Each claim is joined on the full key (subject, opposite predicate, object); with unique triples
    both sides hold at most one claim per key.
    """
    left, right = _sides(claims, extra)
    left = left.withColumn("_want", F.explode(P.opposites_of(F.col("predicate_1"))))
    joined = left.join(
        right,
        (F.col("subject_1") == F.col("subject_2")) & (F.col("object_1") == F.col("object_2"))
        & (F.col("_want") == F.col("predicate_2")) & (F.col("claim_id_1") < F.col("claim_id_2")),
    )
    return _typed(joined.drop("_want"), "direct")


def comparative_pairs(claims: DataFrame, extra: list[str] = []) -> DataFrame:
    """A over B against B over A by the same comparative predicate."""
    left, right = _sides(claims.where(P.is_comparative(F.col("predicate"))), extra)
    joined = left.join(
        right,
        (F.col("subject_1") == F.col("object_2")) & (F.col("object_1") == F.col("subject_2"))
        & (F.col("predicate_1") == F.col("predicate_2")) & (F.col("claim_id_1") < F.col("claim_id_2")),
    )
    return _typed(joined, "comparative")


def _negation_sides(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims under the key (subject, predicate, pattern), positive and negative objects apart."""
    def side(positive: bool) -> DataFrame:
        return claims.withColumn("pattern", F.explode(P.negation_classes(F.col("object"), positive)))

    return side(True), side(False)


def negation_counts(claims: DataFrame) -> DataFrame:
    """Contradicting pairs per (subject, predicate, pattern), counted without forming them.

    A positive object matches one pattern only, so no pair is counted under two patterns.
    """
    key = ["subject", "predicate", "pattern"]
    positive, negative = _negation_sides(claims)
    p = positive.groupBy(*key).agg(F.count(F.lit(1)).alias("positive"))
    n = negative.groupBy(*key).agg(F.count(F.lit(1)).alias("negative"))
    return p.join(n, key).withColumn("pairs", F.col("positive") * F.col("negative"))


def _keyed_sides(claims: DataFrame) -> DataFrame:
    """Every claim under the structural keys it may contradict others by: (id, vec, key, side, kind).

    Two claims contradict each other exactly if they stand under one key on opposite sides: for direct
    pairs the key holds subject, object and the two opposite predicates, for comparative ones the
    predicate and both ends, for negations subject, predicate and pattern.
    """
    rows = unit_vectors(claims.withColumn("id", F.col("claim_id"))).select("id", "vec", *TRIPLE)

    def under(kind: str, frame: DataFrame, key: list[Column], side: Column) -> DataFrame:
        return frame.select("id", "vec", F.to_json(F.array(F.lit(kind), *key)).alias("key"), side.alias("side"), F.lit(kind).alias("kind"))

    subject, predicate, object_ = (F.col(c) for c in TRIPLE)
    opposed = rows.withColumn("_want", F.explode(P.opposites_of(predicate)))
    low, high = F.least(predicate, "_want"), F.greatest(predicate, "_want")
    direct = under("direct", opposed, [subject, object_, low, high], (predicate == high).cast("int"))
    compared = rows.where(P.is_comparative(predicate))
    ends = [predicate, F.least(subject, object_), F.greatest(subject, object_)]
    # A claim about one thing alone stands on both sides.
    sides = F.when(subject == object_, F.array(F.lit(0), F.lit(1))).otherwise(F.array((subject > object_).cast("int")))
    compared = compared.withColumn("_side", F.explode(sides))
    comparative = under("comparative", compared, ends, F.col("_side"))
    positive, negative = _negation_sides(rows)
    parts = [direct, comparative]
    for side, frame in enumerate((positive, negative)):
        parts.append(under("negation", frame, [subject, predicate, F.col("pattern").cast("string")], F.lit(side)))
    return reduce(DataFrame.unionByName, parts)


def _meet(left: DataFrame, right: DataFrame, min_similarity: float, plan: BlockPlan) -> DataFrame:
    """Similar pairs of equal keys: (id_l, id_r, similarity, kind), each once."""
    id_kind = left.schema["id"].dataType.simpleString()

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(same_key(lpdf, rpdf) & (dots >= min_similarity))
        return pd.DataFrame({
            "id_l": lpdf["id"].to_numpy()[i], "id_r": rpdf["id"].to_numpy()[j], "similarity": dots[i, j],
            "kind": lpdf["kind"].to_numpy()[i],
        })

    schema = f"id_l {id_kind}, id_r {id_kind}, similarity double, kind string"
    found = keyed_block_join(left, right, block, schema, plan)
    # A pair may stand under several patterns, or on both sides of a key.
    return found.where("id_l <> id_r").dropDuplicates(["id_l", "id_r", "kind"])


def _confident(pairs: DataFrame) -> DataFrame:
    value = F.lit(None).cast("double")
    for kind, confidence in vocab.CONTRADICTION_CONFIDENCE.items():
        value = F.when(F.col("contradiction_type") == kind, F.lit(confidence)).otherwise(value)
    return pairs.withColumn("confidence", value)


def structural_contradictions(
    claims: DataFrame, min_similarity: float = 0.7, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """All structural contradictions whose claims are similar enough; triples may repeat.

    The three types exclude each other: direct needs differing predicates, comparative swapped
    ends, negation equal subjects with objects of opposite sign. All of them are one join on the
    structural key, in which crowded keys are cut into blocks.
    """
    sides = materialize(_keyed_sides(claims.select("claim_id", *TRIPLE, "embedding")))
    met = _meet(sides.where("side = 0"), sides.where("side = 1"), min_similarity, plan)
    pairs = met.select(
        F.least("id_l", "id_r").alias("claim_id_1"), F.greatest("id_l", "id_r").alias("claim_id_2"), "similarity",
        F.col("kind").alias("contradiction_type"),
    )
    return _confident(pairs.dropDuplicates(["claim_id_1", "claim_id_2", "contradiction_type"]))


def similar_negations(claims: DataFrame, min_similarity: float, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Negation pairs at or above the similarity: ids and similarity only."""
    sides = materialize(_keyed_sides(claims.select("claim_id", *TRIPLE, "embedding")).where("kind = 'negation'"))
    met = _meet(sides.where("side = 0"), sides.where("side = 1"), min_similarity, plan)
    return met.select(
        F.least("id_l", "id_r").alias("claim_id_1"), F.greatest("id_l", "id_r").alias("claim_id_2"), "similarity"
    ).dropDuplicates(["claim_id_1", "claim_id_2"])


def with_claim_text(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    for side in ("1", "2"):
        told = claims.select(
            F.col("claim_id").alias(f"claim_id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in TRIPLE]
        )
        pairs = pairs.join(told, f"claim_id_{side}")
    return pairs


def detect_contradictions(
    claims: DataFrame, min_similarity: float = 0.7, limit: int = 100, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """The top contradictions by confidence, similarity and ids."""
    found = structural_contradictions(claims, min_similarity, plan)
    top = found.orderBy(F.desc("confidence"), F.desc("similarity"), "claim_id_1", "claim_id_2").limit(limit)
    return with_claim_text(top, claims)


def contradictions_of(
    claims: DataFrame, sources: DataFrame, min_similarity: float = 0.7, limit: int = 10, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """Contradictions seen from each source claim, the most similar first.

    Only sources stand on the left of the join, each against the other side of its keys.
    """
    from colloquy.operators.ordered import first_rows

    columns = ["claim_id", *TRIPLE, "embedding"]
    asked = claims.select(*columns).join(sources.select("claim_id").distinct(), "claim_id", "left_semi")
    facing = lambda df, side: _keyed_sides(df).withColumn("key", F.concat(side.cast("string"), "key"))
    left = materialize(facing(asked, F.col("side")))
    right = materialize(facing(claims.select(*columns), 1 - F.col("side")))
    seen = _confident(
        _meet(left, right, min_similarity, plan).dropDuplicates(["id_l", "id_r"]).select(
            F.col("id_l").alias("claim_id"), F.col("id_r").alias("other_id"), "similarity", F.col("kind").alias("contradiction_type")
        )
    )
    return first_rows(seen, ["claim_id"], [F.desc("similarity"), F.asc("other_id")], limit, "rank")


# -- verdicts on similar, not structural, pairs ------------------------------------------------------------


def verification_candidates(
    new_claims: DataFrame, claims: DataFrame, min_similarity: float = 0.7, per_claim: int = 5,
    plan: BlockPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Similar pairs without a structural contradiction, as sentences for a verifier."""
    from colloquy.operators.related import related_for_new_claims

    near = related_for_new_claims(new_claims, claims, per_claim, min_similarity, plan)
    own = new_claims.select("claim_id", *[F.col(c).alias(f"{c}_1") for c in TRIPLE])
    pairs = near.join(own, "claim_id")
    return pairs.where(~is_structural()).select(
        F.col("claim_id").alias("claim_id_1"), F.col("related_id").alias("claim_id_2"), "similarity",
        claim_sentence("subject_1", "predicate_1", "object_1").alias("claim_1"),
        claim_sentence("subject", "predicate", "object").alias("claim_2"),
    )


def is_structural() -> Column:
    """Row test for a pair laid out as subject_1.. against subject.. ."""
    s1, p1, o1 = (F.col(f"{c}_1") for c in TRIPLE)
    s2, p2, o2 = (F.col(c) for c in TRIPLE)
    direct = (s1 == s2) & (o1 == o2) & P.are_opposite(p1, p2)
    comparative = (s1 == o2) & (o1 == s2) & (p1 == p2) & P.is_comparative(p1)
    negation = (s1 == s2) & (p1 == p2) & P.are_negated(o1, o2)
    return direct | comparative | negation


def verify_candidates(candidates: DataFrame, store: BucketTable, verifier: Verifier) -> DataFrame:
    """Verdicts on candidate pairs: (claim_id_1, claim_id_2, is_contradiction, confidence, explanation).

    The store keeps every verdict under its pair, and the verifier is asked about unknown pairs only, once
    each and a batch at a time: a list of sentence pairs in, as many verdicts out. Pairs of a batch for which
    it raises stay without a verdict and are asked again next time.
    """
    spark, pair = candidates.sparkSession, ["claim_id_1", "claim_id_2"]
    kinds = dict(candidates.dtypes)
    schema = f"claim_id_1 {kinds['claim_id_1']}, claim_id_2 {kinds['claim_id_2']}, is_contradiction boolean, confidence double, explanation string"
    known = store.read(spark)
    known = spark.createDataFrame([], schema) if known is None else known.select(*[c.split()[0] for c in schema.split(", ")])
    asked = candidates.dropDuplicates(pair).join(known.select(*pair), pair, "left_anti").select(*pair, "claim_1", "claim_2")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            try:
                told = verifier(list(zip(batch["claim_1"], batch["claim_2"])))
            except Exception:  # noqa: BLE001 - the pairs are asked again next time
                continue
            verdicts = pd.DataFrame(told, columns=["is_contradiction", "confidence", "explanation"])
            yield pd.concat([batch[pair].reset_index(drop=True), verdicts], axis=1)

    fresh = materialize(asked.mapInPandas(ask, schema))
    if not fresh.isEmpty():
        store.merge(fresh, lambda old, feed: old.unionByName(feed))
    return known.unionByName(fresh).join(candidates.select(*pair).distinct(), pair, "left_semi")


def confirmed_by_verdicts(candidates: DataFrame, verdicts: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Candidates a verifier confirmed, as edges of type `semantic`."""
    sure = verdicts.where(F.col("is_contradiction") & (F.col("confidence") >= min_confidence))
    return candidates.join(sure, ["claim_id_1", "claim_id_2"]).select(
        "claim_id_1", "claim_id_2", "similarity", F.lit("semantic").alias("contradiction_type"), "confidence", "explanation"
    )


# -- stored edges -----------------------------------------------------------------------------------------------


def contradiction_edges(found: DataFrame, detected_at: Column) -> DataFrame:
    explanation = F.col("explanation") if "explanation" in found.columns else F.lit(None).cast("string")
    return found.select(
        F.col("claim_id_1").alias("src_id"), F.col("claim_id_2").alias("dst_id"), "similarity",
        F.lit("contradicts").alias("relationship"), "contradiction_type", "confidence",
        explanation.alias("explanation"), detected_at.alias("detected_at"),
    )


def stored_contradictions(edges: DataFrame, claims: DataFrame, limit: int = 50) -> DataFrame:
    kept = edges.where(F.col("relationship") == "contradicts").select(
        F.col("src_id").alias("claim_id_1"), F.col("dst_id").alias("claim_id_2"),
        "similarity", "contradiction_type", "confidence", "explanation", "detected_at",
    )
    top = kept.orderBy(F.desc("confidence"), F.desc("similarity"), "claim_id_1", "claim_id_2").limit(limit)
    return with_claim_text(top, claims)


def contradiction_stats(edges: DataFrame, claims: DataFrame, top: int = 10) -> DataFrame:
    """Rows (kind, name, count): the total, all four types, and the most contested values."""
    kept = edges.where(F.col("relationship") == "contradicts").select(F.col("src_id").alias("claim_id"), "contradiction_type")
    spark = edges.sparkSession
    types = spark.createDataFrame([(t,) for t in vocab.CONTRADICTION_TYPES], "name string")
    by_type = kept.groupBy(F.col("contradiction_type").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    rows = kept.agg(F.count(F.lit(1)).alias("count")).select(F.lit("total").alias("kind"), F.lit("all").alias("name"), "count")
    rows = rows.unionByName(types.join(by_type, "name", "left").select(
        F.lit("type").alias("kind"), "name", F.coalesce("count", F.lit(0)).alias("count")
    ))
    told = kept.join(claims.select("claim_id", "subject", "predicate"), "claim_id")
    for column in ("subject", "predicate"):
        counted = told.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("count"))
        best = counted.orderBy(F.desc("count"), "name").limit(top)
        rows = rows.unionByName(best.select(F.lit(column).alias("kind"), "name", "count"))
    return rows
