"""Relational queries over the claim graph: filter, page, detail, counts, statistics."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import vocab

RATED_VALUES = ("agrees", "disagrees", "neutral", "uncertain")


def cutoff(reference: datetime, days: int) -> Column:
    return F.lit(reference - timedelta(days=days)).cast("timestamp_ntz")


@dataclass(frozen=True)
class ClaimQuery:
    """What a reader asks of the claim table; unset fields do not filter."""

    days: int | None = None
    predicate: str | None = None
    subject: str | None = None
    object: str | None = None
    stance: str = "all"
    reference: datetime | None = None

    def __post_init__(self) -> None:
        if self.stance not in ("all", "rated", "unrated", *RATED_VALUES):
            raise ValueError(f"unknown stance filter {self.stance!r}")
        if self.days and self.reference is None:
            raise ValueError("a days filter needs an explicit reference time")

    def condition(self) -> Column:
        """Native comparisons only, so that Parquet receives them as pushed filters."""
        keep = F.lit(True)
        if self.days:
            keep = keep & (F.col("extracted_at") >= cutoff(self.reference, self.days))
        if self.predicate:
            keep = keep & (F.col("predicate") == self.predicate)
        if self.subject:
            keep = keep & F.contains(F.col("subject"), F.lit(self.subject))
        if self.object:
            keep = keep & F.contains(F.col("object"), F.lit(self.object))
        return keep


def one_stance_per_claim(stances: DataFrame) -> DataFrame:
    """The table is unique by claim; this guards against feeds that are not."""
    fields = [c for c in stances.columns if c != "claim_id"]
    packed = F.max(F.struct(F.col("user_stance").isNotNull(), *fields)).alias("s")
    return stances.groupBy("claim_id").agg(packed).select("claim_id", *[f"s.{c}" for c in fields])


def filter_claims(claims: DataFrame, stances: DataFrame | None, query: ClaimQuery) -> DataFrame:
    """Claims that satisfy the query, without reading stances unless the filter needs them."""
    kept = claims.where(query.condition())
    if query.stance == "all":
        return kept
    rated = stances.where(F.col("user_stance").isNotNull())
    if query.stance == "unrated":
        return kept.join(rated.select("claim_id"), "claim_id", "left_anti")
    if query.stance == "rated":
        return kept.join(rated.select("claim_id"), "claim_id", "left_semi")
    return kept.join(rated.where(F.col("user_stance") == query.stance).select("claim_id"), "claim_id", "left_semi")


def with_user_stance(claims: DataFrame, stances: DataFrame) -> DataFrame:
    single = one_stance_per_claim(stances.select("claim_id", "user_stance"))
    return claims.join(single, "claim_id", "left")


def browse(claims: DataFrame, stances: DataFrame, query: ClaimQuery, limit: int, offset: int = 0) -> DataFrame:
    """One page of claims, newest first. Stances are joined for the page only."""
    page = (
        filter_claims(claims, stances, query)
        .select("claim_id", "subject", "predicate", "object", "confidence", "extracted_at")
        .orderBy(F.desc("extracted_at"), "claim_id")
        .offset(offset)
        .limit(limit)
    )
    return with_user_stance(page, stances)


def browse_after(
    claims: DataFrame, stances: DataFrame, query: ClaimQuery, limit: int, last_at: datetime, last_id: str
) -> DataFrame:
    """The page that follows the given row: constant cost at any depth, unlike an offset."""
    at = F.lit(last_at).cast("timestamp_ntz")
    later = (F.col("extracted_at") < at) | ((F.col("extracted_at") == at) & (F.col("claim_id") > last_id))
    return browse(claims.where(later), stances, query, limit)


def count_claims(claims: DataFrame, stances: DataFrame | None, query: ClaimQuery) -> DataFrame:
    return filter_claims(claims, stances, query).agg(F.count(F.lit(1)).alias("count"))


def claim_details(claims: DataFrame, predicates: DataFrame, stances: DataFrame) -> DataFrame:
    """Claims with predicate description and stances, defaults filled in."""
    # The registry holds one row per distinct predicate name; Spark decides how to join it.
    known = predicates.select(F.col("name").alias("predicate"), "description", "is_builtin")
    return (
        claims.join(known, "predicate", "left")
        .join(one_stance_per_claim(stances), "claim_id", "left")
        .select(
            "claim_id", "subject", "predicate", "object", "confidence", "extracted_at",
            F.col("description").alias("predicate_description"),
            F.coalesce("is_builtin", F.lit(False)).alias("predicate_is_builtin"),
            F.coalesce("content_author_stance", F.lit("not-stated")).alias("content_author_stance"),
            F.coalesce("commenter_agree_pct", F.lit(0.0)).alias("commenter_agree_pct"),
            F.coalesce("commenter_disagree_pct", F.lit(0.0)).alias("commenter_disagree_pct"),
            "user_stance", "user_note",
        )
    )


def my_stances(claims: DataFrame, stances: DataFrame) -> DataFrame:
    rated = stances.where(F.col("user_stance").isNotNull()).select("claim_id", "user_stance", "user_note")
    return rated.join(claims.select("claim_id", "subject", "predicate", "object"), "claim_id")


def is_valid_claim(min_confidence: float = 0.5) -> Column:
    filled = F.lit(True)
    for name in ("subject", "predicate", "object"):
        filled = filled & (F.coalesce(F.col(name), F.lit("")) != "")
    return filled & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)


def top_values(claims: DataFrame, column: str, n: int, since: Column | None = None) -> DataFrame:
    kept = claims if since is None else claims.where(F.col("extracted_at") >= since)
    counted = kept.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), column).limit(n)


def claims_of_subreddit(claims: DataFrame, posts: DataFrame, subreddit: str) -> DataFrame:
    wanted = posts.where(F.col("subreddit") == subreddit).select("post_id")
    return claims.join(wanted, "post_id", "left_semi")


def embedding_stats(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"),
        F.count_if(F.col("is_canonical")).alias("canonical"),
        F.count_if(~F.col("is_canonical")).alias("duplicates"),
    )


def seed_predicates(spark: SparkSession) -> DataFrame:
    rows = [(name, text, True, 0) for name, text in vocab.SEED_PREDICATES]
    return spark.createDataFrame(rows, "name string, description string, is_builtin boolean, usage_count bigint")


def count_predicate_use(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """Registry with every saved claim counted; unknown names enter as not built in."""
    used = claims.groupBy(F.col("predicate").alias("name")).agg(
        F.count(F.lit(1)).alias("used"), F.min("extracted_at").alias("seen_at")
    )
    return registry.join(used, "name", "full_outer").select(
        "name", "description",
        F.coalesce("is_builtin", F.lit(False)).alias("is_builtin"),
        F.when(F.col("is_builtin").isNull(), F.col("seen_at")).alias("first_seen"),
        (F.coalesce("usage_count", F.lit(0)) + F.coalesce("used", F.lit(0))).alias("usage_count"),
    )


def new_predicates(registry: DataFrame) -> DataFrame:
    return registry.where(~F.col("is_builtin")).orderBy(F.desc("first_seen"), "name")


def predicates_by_use(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("usage_count"), "name")


def upsert_triples(claims: DataFrame) -> DataFrame:
    """One row per triple with the highest confidence and the first extraction time."""
    return claims.groupBy("subject", "predicate", "object").agg(
        F.max("confidence").alias("confidence"),
        F.min("extracted_at").alias("extracted_at"),
        F.min("claim_id").alias("claim_id"),
    )


def canonical_embedded(claims: DataFrame) -> DataFrame:
    """The scan every semantic operator starts from."""
    return claims.where(F.col("embedding").isNotNull() & F.col("is_canonical"))
