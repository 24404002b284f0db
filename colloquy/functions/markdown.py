"""Markdown of single rows and of parsed response structs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions.text import (
    cut_words, escape_markdown, escape_table_cell, human_date, percent, priority_icon, slug, trim_ws,
)


def _lines(items: Column, line) -> Column:
    """One line per element, each ended by a newline; empty for no elements."""
    return F.array_join(F.transform(items, lambda e: F.concat(line(e), F.lit("\n"))), "")


def _when_any(items: Column, body: Column) -> Column:
    return F.when(F.size(items) > 0, body).otherwise("")


def _icon(kind: Column, icons: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in icons.items() for x in pair])
    return F.coalesce(table[kind], F.lit(default)) if default is not None else table[kind]


def _pct(value: Column) -> Column:
    return percent(value).cast("string")


# -- digest rows -----------------------------------------------------------------------------------------


def digest_header(title: str, day: Column, posts: Column, subreddits: Column, claims: Column) -> Column:
    text = day.cast("string")
    return F.concat(
        F.lit(f"# {title} - "), text, F.lit("\n\n*"), human_date(text), F.lit(" • "), posts.cast("string"), F.lit(" posts • "),
        subreddits.cast("string"), F.lit(" subreddits • "), claims.cast("string"), F.lit(" claims extracted*\n\n"),
    )


def what_matters_row(priority: Column, topic: Column, impact: Column, status: Column) -> Column:
    return F.concat(
        F.lit("| "), priority_icon(priority), F.lit(" **"), escape_markdown(topic), F.lit("** | "), escape_markdown(impact),
        F.lit(" | "), escape_markdown(status), F.lit(" |\n"),
    )


def _controversy_label(level: Column) -> Column:
    name = F.when(level == "high", "High").when(level == "medium", "Medium").otherwise("Low")
    return F.when(level.isNotNull() & (level != "none"), F.concat(F.lit(" • Controversy: "), name)).otherwise("")


def discussion_header(title: Column, url: Column, subreddit: Column, score: Column, confidence: Column, level: Column) -> Column:
    return F.concat(
        F.lit("### ["), escape_markdown(title), F.lit("]("), url, F.lit(") • r/"), escape_markdown(subreddit), F.lit("\n**Score: "),
        score.cast("string"), F.lit(" • Confidence: "), _pct(confidence), F.lit("%**"), _controversy_label(level), F.lit("\n\n"),
    )


def story_block(narrative: Column) -> Column:
    told = trim_ws(F.coalesce(narrative, F.lit("")))
    return F.when(told != "", F.concat(F.lit(vocab.THE_STORY + "\n"), escape_markdown(told), F.lit("\n\n"))).otherwise("")


def threads_block(threads: Column) -> Column:
    """Array of struct(type, insight)."""
    line = lambda t: F.concat(F.lit("- "), _icon(t["type"], vocab.DISCUSSION_THREAD_ICONS, "•"), F.lit(" "), escape_markdown(t["insight"]))
    return _when_any(threads, F.concat(F.lit(vocab.NOTABLE_THREADS + "\n"), _lines(threads, line), F.lit("\n")))


def claims_block(claims: Column) -> Column:
    """Array of struct(text, confidence, is_verified)."""
    line = lambda c: F.concat(
        F.lit("- "), F.when(c["is_verified"], "✓").otherwise("?"), F.lit(" "), escape_markdown(c["text"]), F.lit(" ("), _pct(c["confidence"]), F.lit("%)")
    )
    return _when_any(claims, F.concat(F.lit(vocab.HIGH_CONFIDENCE_CLAIMS), _lines(claims, line), F.lit("\n")))


def post_section(
    title: Column, url: Column, score: Column, comments: Column, confidence: Column, level: Column, narrative: Column,
    hook: Column, summary: Column, missing_context: Column, threads: Column, claims: Column,
) -> Column:
    mark = F.when(level == "high", vocab.CONTROVERSIAL_MARK).when(level == "medium", vocab.DEBATE_MARK).otherwise("")
    has_hook = F.coalesce(hook, F.lit("")) != ""
    story = F.when(F.coalesce(narrative, F.lit("")) == "", "").when(
        has_hook, F.concat(F.lit(vocab.THE_STORY + " *"), escape_markdown(hook), F.lit("*\n\n"), escape_markdown(narrative), F.lit("\n\n"))
    ).otherwise(F.concat(F.lit(vocab.THE_STORY + " "), escape_markdown(narrative), F.lit("\n\n")))
    context = F.array_join(F.transform(F.slice(missing_context, 1, 2), escape_markdown), ", ")
    warning = F.when(
        (confidence < 0.75) & (F.size(missing_context) > 0), F.concat(F.lit(vocab.MISSING_CONTEXT), context, F.lit("\n\n"))
    ).otherwise("")
    return F.concat(
        F.lit("### ["), escape_markdown(title), F.lit("]("), url, F.lit(") {#"), slug(title), F.lit("}\n\n**"), score.cast("string"),
        F.lit("↑** • "), comments.cast("string"), F.lit(" comments • "), _pct(confidence), F.lit("% confidence"), mark, F.lit("\n\n"),
        story, escape_markdown(summary), F.lit("\n\n"), warning, threads_block(threads), claims_block(claims), F.lit("---\n\n"),
    )


def low_activity_head(posts: Column) -> Column:
    told = F.when(posts == 1, F.lit("1 post with limited discussion")).otherwise(
        F.concat(posts.cast("string"), F.lit(" posts with limited discussion"))
    )
    return F.concat(F.lit(vocab.LOW_ACTIVITY_HEAD), told, F.lit("</summary>\n\n"))


def low_activity_row(title: Column, url: Column, subreddit: Column, score: Column, warning: Column, description: Column) -> Column:
    part = lambda value, before, after: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), escape_markdown(value), F.lit(after))).otherwise("")
    return F.concat(
        F.lit("### ["), escape_markdown(title), F.lit("]("), url, F.lit(") • r/"), escape_markdown(subreddit), F.lit(" • Score: "),
        score.cast("string"), part(warning, " • ⚠️ ", ""), F.lit("\n"), part(description, "", "\n"), F.lit("\n"),
    )


# -- response structs -----------------------------------------------------------------------------------------


def theme_synthesis(themes: Column, conflicts: Column, trends: Column) -> Column:
    """Recurring themes, conflicting viewpoints and emerging patterns; empty blocks vanish."""
    esc_all = lambda items, sep: F.array_join(F.transform(items, escape_markdown), sep)
    theme = lambda t: F.concat(
        F.lit("### "), escape_markdown(t["theme"]), F.lit("\n\n"), escape_markdown(t["summary"]), F.lit("\n\n" + vocab.DISCUSSED_IN),
        _lines(t["posts"], lambda p: F.concat(F.lit("- "), escape_markdown(p))),
    )
    row = lambda c: F.concat(
        F.lit("| **"), escape_table_cell(c["topic"]), F.lit("** | "), escape_table_cell(c["viewpoint_a"]["position"]), F.lit(" | "),
        escape_table_cell(c["viewpoint_b"]["position"]), F.lit(" |"),
    )
    source = lambda c: F.concat(
        F.lit("- *"), escape_markdown(c["topic"]), F.lit('*: View A from "'), esc_all(c["viewpoint_a"]["sources"], ", "),
        F.lit('" • View B from "'), esc_all(c["viewpoint_b"]["sources"], ", "), F.lit('"'),
    )
    trend = lambda t: F.concat(
        F.lit("- **"), escape_markdown(t["trend"]), F.lit("** ("), _pct(t["confidence"]), F.lit("% confidence)\n  - Evidence: "),
        esc_all(t["evidence"], "; "),
    )
    blocks = [
        _when_any(themes, F.concat(F.lit(vocab.TODAYS_THEMES), _lines(themes, theme))),
        _when_any(conflicts, F.concat(
            F.lit(vocab.CONFLICTING_VIEWPOINTS + vocab.VIEWPOINT_TABLE),
            _lines(conflicts, row), F.lit(vocab.VIEWPOINT_SOURCES), _lines(conflicts, source), F.lit("\n"))),
        _when_any(trends, F.concat(F.lit(vocab.EMERGING_PATTERNS), _lines(trends, trend), F.lit("\n"))),
    ]
    # The blocks are joined lines, so the very last line carries no line end.
    return F.regexp_replace(F.concat(*blocks), r"\n\z", "")


def controversy_analysis(a: Column) -> Column:
    points = lambda items, head: _when_any(items, F.concat(F.lit(f"**{head}:**\n"), _lines(items, lambda p: F.concat(F.lit("- "), p)), F.lit("\n")))
    camp = lambda c: F.concat(
        F.lit("- **"), c["camp_name"], F.lit("** (~"), number(c["percentage"]), F.lit("%): "), c["key_argument"]
    )
    split = a["community_split"]
    nuances = a["nuances"]
    text = F.concat(
        F.lit(vocab.MAIN_CLAIM), a["main_claim"], F.lit("\n\n"), points(a["supporting_points"], "Supporting Arguments"),
        points(a["opposing_points"], "Opposing Arguments"),
        _when_any(split, F.concat(F.lit(vocab.COMMUNITY_SPLIT), _lines(split, camp), F.lit("\n"))),
        _when_any(nuances, F.concat(F.lit(vocab.NUANCES), _lines(nuances, lambda p: F.concat(F.lit("- "), p)))),
    )
    return F.regexp_replace(text, r"\n\z", "")


def number(value: Column) -> Column:
    """A number without a trailing fraction of zero."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def story(narrative: Column, hook: Column) -> Column:
    return F.when(
        F.coalesce(hook, F.lit("")) != "", F.concat(F.lit(vocab.THE_STORY + " *"), hook, F.lit("*\n\n"), narrative)
    ).otherwise(F.concat(F.lit(vocab.THE_STORY + " "), narrative))


def notable_threads(threads: Column, icons: bool = True) -> Column:
    icon = lambda t: F.concat(_icon(t["thread_type"], vocab.NOTABLE_THREAD_ICONS, ""), F.lit(" ")) if icons else F.lit("")
    signal = lambda t: F.when(F.coalesce(t["engagement_signal"], F.lit("")) != "", F.concat(F.lit(" *("), t["engagement_signal"], F.lit(")*"))).otherwise("")
    line = lambda t: F.concat(F.lit("\n- "), icon(t), t["insight"], signal(t))
    return _when_any(threads, F.concat(F.lit(vocab.NOTABLE_THREADS), F.array_join(F.transform(threads, line), "")))


def what_matters(items: Column) -> Column:
    def row(i: Column) -> Column:
        official = i["status"]["official"]
        return F.concat(
            F.lit("| "), priority_icon(i["priority"]), F.lit(" | "), escape_table_cell(i["topic"]), F.lit(" | "),
            escape_table_cell(cut_words(i["impact"], 55)), F.lit(" | Community: "), escape_table_cell(i["status"]["community"]),
            F.when(F.coalesce(official, F.lit("")) != "", F.concat(F.lit(" / Official: "), escape_table_cell(official))).otherwise(""),
            F.lit(" |"),
        )

    return _when_any(items, F.concat(
        F.lit(vocab.MATTERS_TODAY_HEAD),
        _lines(items, row), F.lit(vocab.MATTERS_TODAY_TAIL),
    ))


def thread_summaries(summary: Column, threads: Column) -> Column:
    """Array of struct(author, participants, summary); without threads the summary alone."""
    line = lambda t: F.concat(
        F.lit("- *u/"), t["author"], F.lit("* ("), t["participants"].cast("string"), F.lit(" participants): "), t["summary"]
    )
    return F.when(
        F.size(threads) > 0, F.concat(summary, F.lit("\n\n" + vocab.KEY_THREADS), _lines(threads, line))
    ).otherwise(summary)
