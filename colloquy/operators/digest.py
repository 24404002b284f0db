"""The daily digest as ordered markdown fragments, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import markdown as M
from colloquy.functions.text import claim_sentence, impact_line, verification
from colloquy.operators.ordered import row_numbers
from colloquy.operators.selection import top_claims_per_post, what_matters
from colloquy.operators.topics import digest_counts
from colloquy.session import materialize

HEADER, MATTERS, THEMES, CONTRADICTIONS, BREAK, DISCUSSIONS, BY_SUBREDDIT, LOW = range(8)
HEAD, BODY, TAIL = 0, 1, 2


def _fragment(section: int, grp: Column, order: Column, part: int, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), grp.alias("grp"), order.cast("bigint").alias("ord"),
        F.lit(part).alias("part"), text.alias("markdown"),
    )


def _exploded(rows: DataFrame, *fragments: Column) -> DataFrame:
    """The fragments of each row that are not null, in one pass."""
    found = F.explode(F.array_compact(F.array(*fragments))).alias("f")
    return rows.select("digest_date", found).select("digest_date", "f.*")


def claim_lists(claims: DataFrame) -> DataFrame:
    """The confident claims of a post (three at most) as one array."""
    best = top_claims_per_post(claims)
    row = F.struct(
        "claim_no", claim_sentence("subject", "predicate", "object").alias("text"), "confidence",
        (verification("confidence") == "verified").alias("is_verified"),
    )
    return best.groupBy("post_id").agg(F.array_sort(F.collect_list(row)).alias("claims"))


def digest_fragments(
    ranked: DataFrame,
    claims: DataFrame,
    title: str = "Daily Digest",
    themes: DataFrame | None = None,
    contradictions: DataFrame | None = None,
    top_discussions: int = 6,
) -> DataFrame:
    """Fragments (digest_date, section, grp, ord, part, markdown) in reading order of those keys.

    `ranked` are summaries with importance columns; optional story_narrative, story_hook and
    threads columns enrich the posts. `themes` and `contradictions` are (digest_date, markdown).
    """
    for name, kind in (("story_narrative", "string"), ("story_hook", "string"), ("threads", "array<struct<type:string,insight:string>>")):
        if name not in ranked.columns:
            ranked = ranked.withColumn(name, F.lit(None).cast(kind))
    listed = ranked.join(claim_lists(claims), "post_id", "left")
    empty_claims = F.array().cast("array<struct<claim_no:int,text:string,confidence:double,is_verified:boolean>>")
    listed = listed.withColumn("claims", F.coalesce("claims", empty_claims)).withColumn(
        "threads", F.coalesce("threads", F.array().cast("array<struct<type:string,insight:string>>"))
    )
    # Written once, and read once for all fragments of posts.
    listed = materialize(listed)
    col, none = F.col, F.lit("")
    low, active = col("is_low_activity"), ~col("is_low_activity")
    is_top = active & (col("importance_rank") <= top_discussions)
    unsure = F.when(col("confidence") < 0.75, F.lit("Low confidence"))
    posts = _exploded(
        listed,
        F.when(is_top, _fragment(DISCUSSIONS, none, col("importance_rank"), BODY, F.concat(
            M.discussion_header(col("title"), col("url"), col("subreddit"), col("score"), col("confidence"), col("controversy_level")),
            M.story_block(col("story_narrative")), M.threads_block(col("threads")), M.claims_block(col("claims")), F.lit("---\n\n"),
        ))),
        F.when(active, _fragment(BY_SUBREDDIT, col("subreddit"), col("importance_rank"), BODY, M.post_section(
            col("title"), col("url"), col("score"), col("num_comments"), col("confidence"), col("controversy_level"),
            col("story_narrative"), col("story_hook"), col("summary"), col("missing_context"), col("threads"), col("claims")))),
        F.when(low, _fragment(LOW, none, col("importance_rank"), BODY, M.low_activity_row(
            col("title"), col("url"), col("subreddit"), col("score"), unsure, impact_line("summary")))),
    )
    matters = _exploded(what_matters(listed), _fragment(MATTERS, none, col("place"), BODY, M.what_matters_row(
        col("priority"), col("title"), col("impact"), col("sentiment"))))
    groups = _exploded(listed.where(active).select("digest_date", "subreddit").distinct(), _fragment(
        BY_SUBREDDIT, col("subreddit"), F.lit(-1), HEAD, F.concat(F.lit("## r/"), M.escape_markdown("subreddit"), F.lit("\n\n"))))
    # Openings and closings of the sections that a date has; a closing lies behind every group and place.
    seen = listed.groupBy("digest_date").agg(
        F.count_if(active).alias("busy"), F.count_if(is_top).alias("top"), F.count_if(low).alias("low")
    )
    first, last, behind = F.lit(-1), F.lit(2**62), F.lit("\U0010ffff")
    dates = _exploded(
        digest_counts(listed, claims).join(seen, "digest_date"),
        _fragment(HEADER, none, F.lit(0), BODY, M.digest_header(
            title, col("digest_date"), col("post_count"), col("subreddit_count"), col("claim_count"))),
        F.when(col("busy") > 0, _fragment(MATTERS, none, first, HEAD, F.lit(vocab.WHAT_MATTERS_HEAD))),
        F.when(col("busy") > 0, _fragment(MATTERS, behind, last, TAIL, F.lit(vocab.WHAT_MATTERS_TAIL))),
        _fragment(BREAK, none, F.lit(0), BODY, F.lit("---\n\n")),
        F.when(col("top") > 0, _fragment(DISCUSSIONS, none, first, HEAD, F.lit(vocab.TOP_DISCUSSIONS))),
        F.when(col("low") > 0, _fragment(LOW, none, first, HEAD, M.low_activity_head(col("low")))),
        F.when(col("low") > 0, _fragment(LOW, behind, last, TAIL, F.lit(vocab.LOW_ACTIVITY_TAIL))),
    )
    result = dates.unionByName(matters).unionByName(groups).unionByName(posts)
    for section, table in ((THEMES, themes), (CONTRADICTIONS, contradictions)):
        if table is not None:
            result = result.unionByName(_exploded(table, _fragment(section, none, F.lit(0), BODY, col("markdown"))))
    return result


def numbered_fragments(fragments: DataFrame) -> DataFrame:
    """Fragments with their place in the document of their date, found without one task per date."""
    order = [F.asc("section"), F.asc("grp"), F.asc("ord"), F.asc("part")]
    return row_numbers(fragments, ["digest_date"], order, "place").select("digest_date", "place", "markdown")
