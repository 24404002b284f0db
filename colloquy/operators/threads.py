"""Reply-forest analytics by pointer doubling: linear state, log2(depth) rounds.

A comment whose parent is not among the comments is a root. Every node keeps a pointer to its
ancestor at distance `hops` (or to its root when that is nearer); each round doubles the distance.
Subtree totals travel along the same pointers, so no ancestor list is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import excerpt
from colloquy.operators.ordered import first_rows, running_total
from colloquy.session import discard, materialize


def parent_key(parent_id: Column) -> Column:
    return F.regexp_replace(parent_id, "^t[13]_", "")


def _linked(comments: DataFrame) -> DataFrame:
    """Comments with `parent` set only when the parent exists."""
    keyed = comments.withColumn("parent", parent_key(F.col("parent_id")))
    known = comments.select(F.col("comment_id").alias("parent"), F.lit(True).alias("_known"))
    # The right side is unique, so a parent with countless replies skews one side only and the
    # adaptive skew join can split it.
    return keyed.join(known, "parent", "left").withColumn(
        "parent", F.when(F.col("_known"), F.col("parent"))
    ).drop("_known")


def build_forest(comments: DataFrame) -> DataFrame:
    """Adds per comment: parent, root_id, depth (root 0), total_score, reply_count, height.

    `total_score` and `reply_count` cover the whole subtree; `height` counts its levels. Comments
    on a parent cycle belong to no thread and are left out. The forest is a written table without the
    bodies; who needs those joins them to the few comments that are shown.
    """
    nodes = materialize(_linked(comments.drop("body")))
    state = materialize(nodes.select(
        F.col("comment_id").alias("id"),
        F.coalesce("parent", "comment_id").alias("up"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.col("score").cast("bigint").alias("total_score"),
        F.lit(0).cast("bigint").alias("reply_count"),
        F.lit(1).cast("bigint").alias("height"),
    ))
    reach = 1
    while True:
        # Rows whose pointer spans the full distance pass their totals to that ancestor.
        passed = state.where(F.col("hops") == reach).groupBy(F.col("up").alias("id")).agg(
            F.sum("total_score").alias("_score"),
            F.sum(F.col("reply_count") + 1).alias("_replies"),
            F.max(F.col("height") + reach).alias("_height"),
        )
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        past = state
        state = materialize(
            state.join(passed, "id", "left").join(jump, "up", "left").select(
                "id",
                F.col("_up").alias("up"),
                (F.col("hops") + F.col("_hops")).alias("hops"),
                (F.col("total_score") + F.coalesce("_score", F.lit(0))).alias("total_score"),
                (F.col("reply_count") + F.coalesce("_replies", F.lit(0))).alias("reply_count"),
                F.greatest("height", F.coalesce("_height", F.lit(0))).alias("height"),
            )
        )
        discard(past)
        reach *= 2
        unfinished = state.where(F.col("hops") == reach).agg(F.count(F.lit(1)).alias("n")).head()["n"]
        if unfinished == 0:
            break
        if reach > _row_count(state):
            # A pointer longer than the number of comments runs in a circle.
            state = state.where(F.col("hops") < reach)
            break
    settled = state.select(
        F.col("id").alias("comment_id"), F.col("up").alias("root_id"), F.col("hops").alias("depth"),
        "total_score", "reply_count", "height",
    )
    forest = materialize(nodes.join(settled, "comment_id"))
    discard(nodes)
    return forest


def _row_count(state: DataFrame) -> int:
    return state.agg(F.count(F.lit(1)).alias("n")).head()["n"]


def roots_of(forest: DataFrame) -> DataFrame:
    return forest.where(F.col("depth") == 0)


def engagement() -> Column:
    return F.col("total_score") + F.col("reply_count") * 10


def significant_threads(
    forest: DataFrame, min_total_score: int = 20, min_reply_count: int = 2, max_threads: int = 5
) -> DataFrame:
    kept = roots_of(forest).where(
        (F.col("total_score") >= min_total_score) | (F.col("reply_count") >= min_reply_count)
    ).withColumn("engagement", engagement())
    return first_rows(kept, ["post_id"], [F.desc("engagement"), F.asc("comment_id")], max_threads, "thread_rank")


def thread_stats(forest: DataFrame) -> DataFrame:
    """Per post: threads, average and maximum depth (a lone root counts 1), authors, top thread."""
    roots = roots_of(forest).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.avg("height").alias("avg_depth"),
        F.max("height").alias("max_depth"),
        # Most replies first; among equals the earliest id, hence the inverted order below.
        F.min_by(F.struct("author", "reply_count"), F.struct(-F.col("reply_count"), F.col("comment_id"))).alias("top"),
    )
    authors = forest.groupBy("post_id").agg(F.count_distinct("author").alias("total_participants"))
    # A thread without replies is never "most engaged".
    engaged = F.col("top.reply_count") > 0
    return roots.join(authors, "post_id").select(
        "post_id", "total_threads", "avg_depth", "max_depth", "total_participants",
        F.when(engaged, F.col("top.author")).alias("most_engaged_author"),
        F.when(engaged, F.col("top.reply_count")).alias("most_engaged_replies"),
    )


def thread_participants(forest: DataFrame) -> DataFrame:
    """Per thread: distinct authors and the sentiment label of its total score."""
    people = forest.groupBy("root_id").agg(F.count_distinct("author").alias("participants"))
    label = F.when(F.col("total_score") > 50, "positive").when(F.col("total_score") < 0, "negative").otherwise("mixed")
    return roots_of(forest).join(people, "root_id").select(
        "post_id", "root_id", "author", "total_score", "participants", label.alias("sentiment")
    )


def rendered_threads(forest: DataFrame, comments: DataFrame, max_depth: int = 4, max_length: int = 300, max_replies: int = 3) -> DataFrame:
    """Text of each thread: at most three best replies per level down to the given depth.

    Only rows that survive at every level are carried down, so a thread keeps at most
    1 + 3 + 9 + 27 + 81 lines whatever its size, and one bounded array per thread is assembled. What is shown
    of the bodies, never a whole one, is joined to those lines only.
    """
    shallow = forest.where(F.col("depth") <= max_depth).select(
        "comment_id", "post_id", "parent", "root_id", "depth", "author", "score"
    )
    ranked = first_rows(shallow.where("depth > 0"), ["parent"], [F.desc("score"), F.asc("comment_id")], max_replies, "place")
    level = shallow.where("depth = 0").select("comment_id", "post_id", "root_id", "depth", "author", "score",
                                              F.array().cast("array<int>").alias("path"))
    ranked = materialize(ranked)
    lines = level
    for depth in range(1, max_depth + 1):
        above = level.select(F.col("comment_id").alias("parent"), F.col("path").alias("_path"))
        level = ranked.where(F.col("depth") == depth).join(above, "parent").select(
            "comment_id", "post_id", "root_id", "depth", "author", "score",
            F.concat("_path", F.array("place")).alias("path"),
        )
        lines = lines.unionByName(level)
    lines = lines.join(comments.select("comment_id", excerpt("body", max_length).alias("shown")), "comment_id")
    signed = F.when(F.col("score") >= 0, F.concat(F.lit("+"), F.col("score").cast("string"))).otherwise(
        F.col("score").cast("string")
    )
    text = F.concat(
        F.repeat(F.lit("  "), F.col("depth").cast("int")),
        F.when(F.col("depth") == 0, "[Parent]").otherwise("[Reply]"),
        F.lit(" u/"), F.col("author"), F.lit(" ("), signed, F.lit('): "'), F.col("shown"), F.lit('"'),
    )
    ordered = F.array_sort(F.collect_list(F.struct("path", text.alias("text"))))
    return lines.groupBy("post_id", "root_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("thread_text"),
        F.count(F.lit(1)).alias("lines"),
    )


def flattened(forest: DataFrame) -> DataFrame:
    """Position of each comment in the pre-order of its thread (root 0), without path arrays.

    A node lies one place after its parent plus the subtrees of its earlier siblings. Those
    offsets are added up along the pointers to the root, again by doubling. Sibling offsets are running
    totals over ranges of rows, so a comment with countless replies, even within one hour, is spread out.
    """
    replies = forest.where(F.col("parent").isNotNull()).select(
        "comment_id", "parent", "created_at", (F.col("reply_count") + 1).alias("size")
    )
    offset = running_total(
        replies, ["parent"], [F.col("created_at"), F.col("comment_id")], F.col("size"), "earlier"
    ).select("comment_id", (F.col("earlier") + 1).alias("offset"))
    state = materialize(forest.join(offset, "comment_id", "left").select(
        F.col("comment_id").alias("id"), F.coalesce("parent", "comment_id").alias("up"),
        F.coalesce("offset", F.lit(0)).cast("bigint").alias("position"), "depth",
    ))
    deepest = state.agg(F.max("depth").alias("d")).head()["d"] or 0
    reach = 1
    while reach < deepest:
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("position").alias("_position"))
        state = materialize(state.join(jump, "up").select(
            "id", F.col("_up").alias("up"), (F.col("position") + F.col("_position")).alias("position"), "depth"
        ))
        reach *= 2
    placed = state.select(F.col("id").alias("comment_id"), F.col("position"))
    return forest.join(placed, "comment_id").select("post_id", "root_id", "comment_id", "depth", "position")
