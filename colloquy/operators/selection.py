"""Choosing posts and comments, and ranking posts by importance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import signals as S
from colloquy.functions.text import half_up, impact_line, priority
from colloquy.operators.ordered import first_rows, row_numbers
from colloquy.operators.threads import parent_key
from colloquy.session import materialize


def recent_posts(posts: DataFrame, reference: Column, lookback_hours: int) -> DataFrame:
    return posts.where(F.col("created_at") >= reference - F.expr(f"INTERVAL {lookback_hours} HOURS"))


def select_posts(posts: DataFrame, per_subreddit: int, min_relative_score: float) -> DataFrame:
    """First posts in feed order whose score reaches a share of their subreddit's average."""
    means = posts.groupBy("subreddit").agg(F.avg("score").alias("avg_score"))
    good = posts.join(means, "subreddit").where(F.col("score") >= F.col("avg_score") * min_relative_score)
    return first_rows(good, ["subreddit"], [F.asc("feed_pos"), F.asc("post_id")], per_subreddit, "pick_no")


def top_comments(comments: DataFrame, limit: int = 50) -> DataFrame:
    return first_rows(comments, ["post_id"], [F.desc("score"), F.asc("comment_id")], limit, "rank")


def reply_counts(comments: DataFrame) -> DataFrame:
    """Direct replies per comment, zero included."""
    counts = comments.groupBy(parent_key(F.col("parent_id")).alias("comment_id")).agg(F.count(F.lit(1)).alias("replies"))
    return comments.join(counts, "comment_id", "left").withColumn("replies", F.coalesce("replies", F.lit(0)))


def substantive(min_length: int = 50) -> Column:
    return (F.length("body") >= min_length) & (F.col("author") != "[deleted]")


def diverse_comments(
    comments: DataFrame,
    count: int,
    top_weight: float = 0.4,
    replied_weight: float = 0.2,
    controversial_weight: float = 0.2,
    min_length: int = 50,
) -> DataFrame:
    """Up to `count` comments per post that spread over viewpoints: (post_id, pick_no, comment_id, category).

    No order needs more than its first `count` rows, because at most that many were taken before.
    The sequential picking happens on these few ids with array functions.
    """
    n_top = math.ceil(count * top_weight)
    n_replied = math.ceil(count * replied_weight)
    n_controversial = math.ceil(count * controversial_weight)

    # What is asked of a body is told before the shuffles, which then carry none.
    told = comments.withColumn("lowered", F.lower("body")).select(
        "post_id", "comment_id", "parent_id", "score", "created_at",
        F.length("body").alias("length"),
        substantive(min_length).alias("good"),
        S.has_controversial_words(F.col("lowered")).alias("debated"),
    )
    rows = reply_counts(told).drop("parent_id")
    stats = rows.groupBy("post_id").agg(
        F.count_if("good").alias("n_good"), F.avg(F.when(F.col("good"), F.col("score"))).alias("avg_score")
    )
    rows = rows.join(stats, "post_id").withColumn("distance", F.abs(F.col("score") - F.col("avg_score")))
    # Below the average, not buried, and long enough to argue.
    rows = rows.withColumn(
        "contrarian", F.col("good") & (F.col("score") < F.col("avg_score")) & (F.col("score") > -10) & (F.col("length") > 100)
    )
    debated = F.col("good") & F.col("debated")
    last = F.asc("comment_id")
    orders = {
        "by_score": (F.col("good"), [F.desc("score")]),
        "by_replies": (F.col("good"), [F.desc("replies")]),
        "by_debate": (debated, [F.asc("distance")]),
        "by_length": (F.col("contrarian"), [F.desc("length")]),
        "by_feed": (F.col("good") | (F.col("n_good") == 0), [F.asc("created_at")]),
    }
    ranked = _first_of_each(materialize(rows), orders, last, count)
    lists = ranked.groupBy("post_id").agg(F.first("n_good").alias("n_good"), *[
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("order") == name, F.struct("place", "comment_id")))), lambda r: r["comment_id"]
        ).alias(name)
        for name in orders
    ])

    def take(from_list: str, taken: Column, upto: int) -> Column:
        free = F.array_except(F.col(from_list), taken)
        return F.slice(free, F.lit(1), F.greatest(F.lit(upto) - F.size(taken), F.lit(0)))

    picked = lists.withColumn("p1", F.slice("by_score", 1, n_top))
    taken = F.col("p1")
    stages = [
        ("p2", "by_replies", n_top + n_replied),
        ("p3", "by_debate", n_top + n_replied + n_controversial),
        ("p4", "by_length", count),
        ("p5", "by_score", count),
    ]
    for name, source, upto in stages:
        picked = picked.withColumn(name, take(source, taken, upto))
        taken = F.concat(taken, F.col(name))
    few = F.col("n_good") <= count
    labels = {"p1": "top", "p2": "replied", "p3": "controversial", "p4": "contrarian", "p5": "fill"}
    label = lambda ids, text: F.transform(ids, lambda c: F.struct(c.alias("comment_id"), F.lit(text).alias("category")))
    staged = F.concat(*[label(F.col(p), text) for p, text in labels.items()])
    chosen = F.when(few, label(F.slice("by_feed", 1, count), "all")).otherwise(staged)
    return picked.select("post_id", F.posexplode(chosen).alias("pos", "c")).select(
        "post_id", (F.col("pos") + 1).alias("pick_no"), "c.comment_id", "c.category"
    )


def _first_of_each(rows: DataFrame, orders: dict, last: Column, count: int) -> DataFrame:
    """The first `count` eligible rows of a post in every order: (post_id, n_good, comment_id, order, place).

    Each order is a branch of its own, cut right after its ranking, so each map task passes on at most
    `count` rows of a post, however many it has.
    """
    branches = []
    for name, (eligible, by) in orders.items():
        first = first_rows(rows.where(eligible), ["post_id"], [*by, last], count, "place")
        branches.append(first.select("post_id", "n_good", "comment_id", F.lit(name).alias("order"), "place"))
    return reduce(DataFrame.unionByName, branches)


# -- importance ----------------------------------------------------------------------------------------


def importance_score() -> Column:
    """Heuristic importance 0..100 from engagement, controversy, density and sentiment."""
    log = lambda name: F.log10(F.greatest(F.lit(1), F.col(name))) * 5
    level, density, mood = F.col("controversy_level"), F.col("information_density"), F.col("sentiment")
    raw = (
        F.least(F.lit(30.0), log("score") + log("num_comments"))
        + F.when(level == "high", 15).when(level == "medium", 8).when(level == "low", 3).otherwise(0)
        + F.when(density == "rich", 10).when(density == "moderate", 5).otherwise(0)
        + F.when(mood == "negative", 10).when(mood == "mixed", 5).otherwise(0)
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), half_up(raw * 1.5))).cast("bigint")


def score_posts(summaries: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Importance per post; a given score wins over the heuristic."""
    scored = summaries.withColumn("heuristic", importance_score())
    if external is None:
        return scored.withColumn("importance_score", F.col("heuristic")).drop("heuristic")
    given = external.groupBy("post_id").agg(F.max("importance_score").alias("_given"))
    return scored.join(given, "post_id", "left").withColumn(
        "importance_score", F.coalesce("_given", "heuristic")
    ).drop("_given", "heuristic")


def low_activity_cut(scored: DataFrame, percentile: int = 20) -> DataFrame:
    """Per date the score at place max(1, floor(n * p / 100)) in ascending order.

    Read off the histogram of scores (at most a hundred-odd rows per date), not off the posts.
    """
    histogram = scored.groupBy("digest_date", "importance_score").agg(F.count(F.lit(1)).alias("n"))
    date = Window.partitionBy("digest_date")
    upto = date.orderBy("importance_score").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(date))
    place = F.greatest(F.lit(1), F.floor(F.col("total") * percentile / 100))
    return placed.where(F.col("upto") >= place).groupBy("digest_date").agg(
        F.min("importance_score").alias("low_activity_threshold")
    )


def rank_posts(scored: DataFrame, percentile: int = 20) -> DataFrame:
    """Adds importance_rank (1 = most important of its date) and is_low_activity."""
    ranked = row_numbers(scored, ["digest_date"], [F.desc("importance_score"), F.asc("post_id")], "importance_rank")
    cuts = low_activity_cut(scored, percentile)
    return ranked.join(cuts, "digest_date").withColumn(
        "is_low_activity", F.col("importance_score") <= F.col("low_activity_threshold")
    )


def apply_rankings(summaries: DataFrame, rankings: DataFrame) -> DataFrame:
    """Rankings joined back; unranked posts get score 50, the last rank and no flag."""
    totals = summaries.groupBy("digest_date").agg(F.count(F.lit(1)).alias("_n"))
    return summaries.join(rankings.select("post_id", "importance_score", "importance_rank", "is_low_activity"), "post_id", "left").join(
        totals, "digest_date"
    ).withColumn("importance_score", F.coalesce("importance_score", F.lit(50))).withColumn(
        "importance_rank", F.coalesce("importance_rank", "_n")
    ).withColumn("is_low_activity", F.coalesce("is_low_activity", F.lit(False))).drop("_n")


def what_matters(ranked: DataFrame, limit: int = 6) -> DataFrame:
    """First posts of each date that are not low-activity, with priority and impact."""
    busy = ranked.where(~F.col("is_low_activity"))
    best = first_rows(busy, ["digest_date"], [F.asc("importance_rank"), F.asc("post_id")], limit, "place")
    return best.withColumn("priority", priority("importance_score", "controversy_level", "sentiment")).withColumn(
        "impact", impact_line("summary")
    )


def top_claims_per_post(claims: DataFrame, min_confidence: float = 0.8, limit: int = 3) -> DataFrame:
    """First confident claims of each post in extraction order."""
    good = claims.where(F.col("confidence") >= min_confidence)
    return first_rows(good, ["post_id"], [F.asc("extracted_at"), F.asc("claim_id")], limit, "claim_no")
