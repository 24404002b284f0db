"""Controversy of a post from its comments, and the routes that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import signals as S
from colloquy.functions.text import percent
from colloquy.session import bound_batches


def comment_signals(comments: DataFrame) -> DataFrame:
    """One combinable aggregate per post; masks unite by bit-or, so no text is collected.

    Each body gets the space that would follow it in the joined text, so a keyword that ends in a
    space also matches at the end of a body.
    """
    bound_batches(comments.sparkSession)
    told = comments.select("post_id", "score", S.text_signals(F.concat("body", F.lit(" "))).alias("signals"))
    return told.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.stddev_pop("score").alias("score_stddev"),
        F.avg(F.when(F.col("score") < 0, 1.0).otherwise(0.0)).alias("negative_ratio"),
        F.bit_or("signals").alias("signals"),
        F.count_if(S.is_positive_text(F.col("signals"))).alias("positive_comments"),
        F.count_if(S.is_negative_text(F.col("signals"))).alias("negative_comments"),
    )


def reply_depths(forest: DataFrame) -> DataFrame:
    return forest.groupBy("post_id").agg((F.max("depth") + 1).alias("reply_depth"))


def detect_controversy(posts: DataFrame, comments: DataFrame, forest: DataFrame) -> DataFrame:
    """Signals, score (0..1) and flag per post; posts without comments score on their own text."""
    bound_batches(posts.sparkSession)
    text = F.concat("title", F.lit(" "), F.coalesce("content", F.lit("")), F.lit(" "))
    # The texts of the posts are asked before the joins, which then carry none.
    own = posts.select("post_id", S.text_signals(text).alias("own"))
    joined = own.join(comment_signals(comments), "post_id", "left").join(reply_depths(forest), "post_id", "left")
    joined = joined.withColumn("found", F.coalesce("signals", F.lit(0)).bitwiseOR(F.col("own")))
    signals = joined.select(
        "post_id",
        F.coalesce("score_stddev", F.lit(0.0)).alias("score_stddev"),
        F.coalesce("negative_ratio", F.lit(0.0)).alias("negative_ratio"),
        F.coalesce("reply_depth", F.lit(0)).alias("reply_depth"),
        F.coalesce("comment_count", F.lit(0)).alias("comment_count"),
        S.keyword_names(S.keyword_mask(F.col("found"))).alias("keyword_hits"),
        S.camp_names(S.camp_mask(F.col("found"))).alias("camps"),
        F.coalesce((F.col("positive_comments") >= 2) & (F.col("negative_comments") >= 2), F.lit(False)).alias("sentiment_mix"),
    )
    score = controversy_score()
    # Sums of tenths carry binary noise; the cut at 0.4 is taken on the rounded score.
    return signals.withColumn("controversy_score", F.round(score, 4)).withColumn(
        "is_controversial", F.col("controversy_score") >= 0.4
    )


def controversy_score() -> Column:
    spread, negative, depth = F.col("score_stddev"), F.col("negative_ratio"), F.col("reply_depth")
    hits, camps = F.size("keyword_hits"), F.size("camps")
    step = lambda high, a, low, b: F.when(high, a).when(low, b).otherwise(0.0)
    total = (
        step(spread > 100, 0.3, spread > 50, 0.15)
        + step(negative > 0.2, 0.2, negative > 0.1, 0.1)
        + step(depth >= 5, 0.2, depth >= 3, 0.1)
        + step(hits >= 5, 0.2, hits >= 2, 0.1)
        + F.when(F.col("sentiment_mix"), 0.15).otherwise(0.0)
        + F.when(camps >= 2, 0.15).otherwise(0.0)
    )
    return F.least(F.lit(1.0), total)


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def controversy_report(detected: DataFrame) -> DataFrame:
    lines = F.concat(
        F.lit("Controversy Score: "), percent("controversy_score").cast("string"), F.lit("%\nIs Controversial: "),
        F.col("is_controversial").cast("string"), F.lit("\nSignals:\n  - Score Variance: "), _fixed(F.col("score_stddev"), 1),
        F.lit("\n  - Negative Ratio: "), _fixed(F.col("negative_ratio") * 100, 1), F.lit("%\n  - Reply Depth: "),
        F.col("reply_depth").cast("string"), F.lit("\n  - Keyword Hits: "), F.size("keyword_hits").cast("string"),
        F.lit("\n  - Sentiment Mix: "), F.col("sentiment_mix").cast("string"),
        F.when(F.size("camps") > 0, F.concat(F.lit("\nDetected Camps: "), F.array_join("camps", ", "))).otherwise(""),
    )
    return detected.select("post_id", lines.alias("report"))


def summary_route(
    detected: DataFrame, thread_stats: DataFrame, threshold: float = 0.5, min_comments: int = 20
) -> DataFrame:
    """Which way a post is summarized: cot before hierarchical before standard."""
    joined = detected.join(thread_stats.select("post_id", "max_depth", "total_participants"), "post_id", "left")
    deep = (F.col("max_depth") >= 3) | (F.col("total_participants") >= 10)
    hierarchical = (F.col("comment_count") >= min_comments) & F.coalesce(deep, F.lit(False))
    route = F.when(F.col("controversy_score") >= threshold, "cot").when(hierarchical, "hierarchical").otherwise("standard")
    return joined.select("post_id", "controversy_score", hierarchical.alias("use_hierarchical"), route.alias("route"))


def should_narrate(score: Column, num_comments: Column, density: Column) -> Column:
    quiet = (score < 10) & (num_comments < 5)
    sparse = density.eqNullSafe("sparse") & (score < 100) & (num_comments < 20)
    return ~quiet & ~sparse


def daily_gates(summaries: DataFrame, threads: DataFrame) -> DataFrame:
    """Per date: may themes be synthesized, posts ranked, topics picked, threads identified."""
    posts = summaries.groupBy("digest_date").agg(F.count(F.lit(1)).alias("posts"))
    per_post = threads.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    identified = summaries.join(per_post, "post_id", "left_semi").groupBy("digest_date").agg(
        F.count(F.lit(1)).alias("posts_with_threads")
    )
    return posts.join(identified, "digest_date", "left").select(
        "digest_date", "posts",
        (F.col("posts") >= 3).alias("synthesize_themes"),
        (F.col("posts") >= 2).alias("rank_posts"),
        (F.col("posts") >= 2).alias("synthesize_what_matters"),
        F.coalesce("posts_with_threads", F.lit(0)).alias("posts_with_threads"),
    )


def comment_diversity(comments: DataFrame) -> DataFrame:
    return comments.withColumn("lowered", F.lower("body")).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.stddev_pop("score").alias("score_stddev"),
        F.count_if(S.has_controversial_words(F.col("lowered"))).alias("controversial_count"),
        F.avg(F.length("body")).alias("avg_body_length"),
    )
