"""Semantic search and related claims: many queries or sources at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.claims import ClaimQuery, canonical_embedded
from colloquy.operators.ordered import first_rows
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan, top_matches, unit_vectors

TRIPLE = ["subject", "predicate", "object"]


def _corpus(claims: DataFrame, canonical_only: bool = True) -> DataFrame:
    kept = canonical_embedded(claims) if canonical_only else claims.where(F.col("embedding").isNotNull())
    return unit_vectors(kept.withColumn("id", F.col("claim_id")))


def find_similar(
    claims: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    min_similarity: float = 0.5,
    canonical_only: bool = True,
    plan: BlockPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Nearest claims of each query row (query_id, embedding, optional exclude_ids array)."""
    seekers = unit_vectors(queries.withColumn("id", F.col("query_id")))
    corpus = _corpus(claims, canonical_only).select("id", "vec")
    keep = ["id", "vec"]
    if "exclude_ids" in queries.columns:
        seekers = seekers.withColumn("exclude", F.col("exclude_ids"))
        corpus = corpus.withColumn("tags", F.array("id"))
        keep.append("exclude")
    found = top_matches(seekers.select(*keep), corpus, limit, min_similarity, plan)
    return found.withColumnRenamed("match_id", "claim_id")


def search(
    claims: DataFrame,
    queries: DataFrame,
    filters: ClaimQuery | None = None,
    limit: int = 20,
    min_similarity: float = 0.5,
    canonical_only: bool = True,
    plan: BlockPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Search with relational filters applied before any similarity is computed."""
    kept = claims if filters is None else claims.where(filters.condition())
    found = find_similar(kept, queries, limit, min_similarity, canonical_only, plan)
    return found.join(claims.select("claim_id", *TRIPLE, "confidence", "extracted_at"), "claim_id")


def suggestions(claims: DataFrame, queries: DataFrame, limit: int = 5, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Distinct subjects among the best matches of a partial query, in order of first appearance."""
    found = search(claims, queries, limit=limit, min_similarity=0.4, plan=plan)
    return suggested_subjects(found)


def suggested_subjects(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "subject").agg(
        F.min("rank").alias("rank"), F.max("similarity").alias("similarity")
    )


def relationship(source: str = "s", target: str = "t") -> Column:
    same = lambda c: F.col(f"{source}.{c}") == F.col(f"{target}.{c}")
    return (
        F.when(same("subject"), "same-subject").when(same("predicate"), "same-predicate")
        .when(same("object"), "same-object").otherwise("similar")
    )


def find_related(
    claims: DataFrame,
    sources: DataFrame,
    limit: int = 10,
    min_similarity: float = 0.6,
    duplicate_edges: DataFrame | None = None,
    plan: BlockPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Related claims of every source claim that has an embedding.

    Left out are the source itself, claims whose canonical claim it is, and claims linked to it by
    a duplicate edge. Edges stay rows, so neither end may have too many.
    """
    pointed = F.array_compact(F.array(F.col("id"), F.col("canonical_claim")))
    corpus = _corpus(claims).withColumn("tags", pointed).select("id", "vec", "tags")
    seekers = unit_vectors(sources.withColumn("id", F.col("claim_id"))).withColumn("exclude", F.array("id"))
    excluded = None
    if duplicate_edges is not None:
        excluded = duplicate_edges.select(F.col("dst_id").alias("query_id"), F.col("src_id").alias("match_id")).join(
            sources.select(F.col("claim_id").alias("query_id")), "query_id", "left_semi"
        )
    found = top_matches(seekers.select("id", "vec", "exclude"), corpus, limit, min_similarity, plan, excluded)
    return describe_matches(found, sources, claims)


def describe_matches(found: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    left = sources.select(F.col("claim_id").alias("query_id"), F.struct(*TRIPLE).alias("s"))
    right = claims.select(F.col("claim_id").alias("match_id"), F.struct(*TRIPLE, "extracted_at").alias("t"))
    return found.join(left, "query_id").join(right, "match_id").select(
        F.col("query_id").alias("claim_id"), F.col("match_id").alias("related_id"), "similarity", "rank",
        relationship().alias("relationship"), "t.subject", "t.predicate", "t.object", "t.extracted_at",
    )


def find_related_grouped(claims: DataFrame, sources: DataFrame, limit: int = 10, **options) -> DataFrame:
    """Twice the limit is fetched, then each relationship keeps a quarter of the limit."""
    wide = find_related(claims, sources, limit=limit * 2, **options)
    return first_rows(
        wide, ["claim_id", "relationship"], [F.asc("rank")], math.ceil(limit / 4), "group_rank"
    )


def find_structurally_related(claims: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """Fallback without embeddings: same subject, then same predicate, then same object.

    For each value only its first limit + 1 canonical claims can ever be shown (one may be the
    source itself), so each branch joins a short list per value instead of all equal claims.
    """
    canonical = claims.where("is_canonical")
    claims_array = f"array<{claims.schema['claim_id'].dataType.simpleString()}>"

    result = sources.select("claim_id", *TRIPLE)
    for column in TRIPLE:
        first = first_rows(canonical.select("claim_id", column), [column], [F.asc("claim_id")], limit + 1, "_n")
        lists = first.groupBy(column).agg(F.array_sort(F.collect_list("claim_id")).alias(f"_{column}"))
        result = result.join(lists, column, "left")

    def branch(column: str) -> Column:
        listed = F.coalesce(F.col(f"_{column}"), F.array().cast(claims_array))
        return F.slice(F.filter(listed, lambda c: c != F.col("claim_id")), 1, limit)

    result = result.withColumn("_p1", branch("subject"))
    result = result.withColumn("_p2", F.array_except(branch("predicate"), F.col("_p1")))
    result = result.withColumn("_p3", F.array_except(branch("object"), F.concat("_p1", "_p2")))
    def tagged(column: str, similarity: float, name: str) -> Column:
        return F.transform(F.col(column), lambda c: F.struct(
            c.alias("related_id"), F.lit(similarity).alias("similarity"), F.lit(name).alias("relationship")
        ))

    ranked = F.concat(
        tagged("_p1", 0.7, "same-subject"), tagged("_p2", 0.5, "same-predicate"), tagged("_p3", 0.5, "same-object")
    )
    return result.select("claim_id", F.posexplode(F.slice(ranked, 1, limit)).alias("pos", "r")).select(
        "claim_id", (F.col("pos") + 1).alias("rank"), "r.related_id", "r.similarity", "r.relationship"
    )


def related_for_new_claims(
    new_claims: DataFrame, claims: DataFrame, per_claim: int = 2, min_similarity: float = 0.65,
    plan: BlockPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Existing claims near each new claim; a claim with the very same triple does not count."""
    triple = F.to_json(F.array(*TRIPLE))
    seekers = unit_vectors(new_claims.withColumn("id", F.col("claim_id"))).withColumn("exclude", F.array(triple))
    corpus = _corpus(claims).withColumn("tags", F.array(triple))
    found = top_matches(seekers.select("id", "vec", "exclude"), corpus.select("id", "vec", "tags"), per_claim, min_similarity, plan)
    return describe_matches(found, new_claims, claims).withColumn("related_date", F.to_date("extracted_at"))


def search_themes(themes: DataFrame, queries: DataFrame, limit: int = 10, min_similarity: float = 0.5) -> DataFrame:
    """Active themes whose centroid is near each query vector (query_id, embedding)."""
    active = themes.where("is_active")
    corpus = unit_vectors(active.withColumn("id", F.col("theme_id")), "centroid").select("id", "vec")
    seekers = unit_vectors(queries.withColumn("id", F.col("query_id"))).select("id", "vec")
    found = top_matches(seekers, corpus, limit, min_similarity)
    return found.withColumnRenamed("match_id", "theme_id").join(active.select("theme_id", "name", "claim_count"), "theme_id")


def best_theme(memberships: DataFrame, themes: DataFrame) -> DataFrame:
    """The active theme each claim belongs to most."""
    active = memberships.join(themes.where("is_active").select("theme_id", "name"), "theme_id")
    order = F.struct(-F.col("membership_score"), F.col("theme_id"))
    return active.groupBy("claim_id").agg(
        F.min_by(F.struct("theme_id", "name", "membership_score"), order).alias("t")
    ).select("claim_id", "t.theme_id", "t.name", "t.membership_score")


