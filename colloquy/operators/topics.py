"""Topics shared by posts, conflicts on them, digest counts and usage budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import cost_usd
from colloquy.operators.ordered import running_total


def topic_members(summaries: DataFrame) -> DataFrame:
    """One row per mention; a topic listed twice in a post counts twice."""
    return summaries.select(
        "digest_date", "post_id", "sentiment", "controversy_level", F.explode("key_topics").alias("topic")
    ).withColumn("topic", F.trim(F.lower("topic")))


def topic_clusters(summaries: DataFrame, min_mentions: int = 2) -> DataFrame:
    """Topics with enough mentions, with sentiment and controversy counts; members stay rows."""
    return topic_members(summaries).groupBy("digest_date", "topic").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_distinct("post_id").alias("posts"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count_if(F.col("controversy_level").isin("medium", "high")).alias("controversial"),
    ).where(F.col("mentions") >= min_mentions)


def topic_conflicts(summaries: DataFrame) -> DataFrame:
    opposed = (F.col("positive") > 0) & (F.col("negative") > 0)
    return topic_clusters(summaries).where(opposed | (F.col("controversial") > 0)).withColumn("opposed", opposed)


def digest_counts(summaries: DataFrame, claims: DataFrame) -> DataFrame:
    posts = summaries.groupBy("digest_date").agg(
        F.count(F.lit(1)).alias("post_count"), F.count_distinct("subreddit").alias("subreddit_count")
    )
    extracted = summaries.select("digest_date", "post_id").join(claims, "post_id").groupBy("digest_date").agg(
        F.count(F.lit(1)).alias("claim_count")
    )
    return posts.join(extracted, "digest_date", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))


def usage_totals(usage: DataFrame) -> DataFrame:
    # Token sums are exact integers; the cost follows from them.
    totals = usage.groupBy("run_date").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count(F.lit(1)).alias("requests"),
    )
    return totals.withColumn("cost_usd", cost_usd("input_tokens", "output_tokens"))


def budget_decisions(usage: DataFrame, daily_budget_usd: float, estimate_output: int | None = None) -> DataFrame:
    """Which requests of a day the budget admits: all before the first that does not fit.

    Spending uses recorded tokens, the test uses the estimate (recorded input plus the assumed
    output when given). Everything after the first refusal of a day is refused.
    """
    micro = F.col("input_tokens") * 3 + F.col("output_tokens") * 15  # millionths of a dollar, exact
    output = F.lit(estimate_output) if estimate_output is not None else F.col("output_tokens")
    priced = usage.withColumn("_estimate", F.col("input_tokens") * 3 + output * 15)
    spent = running_total(priced, ["run_date"], [F.asc("seq")], micro, "spent_micro")
    budget = int(round(daily_budget_usd * 1_000_000))
    first_refusal = spent.where(F.lit(budget) - F.col("spent_micro") < F.col("_estimate")).groupBy("run_date").agg(
        F.min("seq").alias("_stop")
    )
    return spent.join(first_refusal, "run_date", "left").select(
        "run_date", "seq", "input_tokens", "output_tokens",
        (F.col("spent_micro") / 1e6).alias("spent_before"),
        (F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).alias("allowed"),
    )
