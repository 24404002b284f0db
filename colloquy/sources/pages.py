"""Stored web pages to articles, link contents and discussion threads."""

from __future__ import annotations

import re
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import vocab
from colloquy.functions import text as X
from colloquy.functions.html import Element, main_text, page_title, parse


_ARTICLE = T.StructType().add("title", T.StringType()).add("content", T.StringType())


@F.pandas_udf(_ARTICLE)
def _article(html: pd.Series, domain: pd.Series) -> pd.DataFrame:
    titles, contents = [], []
    for source, host in zip(html, domain):
        if not source:
            titles.append("")
            contents.append("")
            continue
        root = parse(source)
        titles.append(page_title(root))
        contents.append(main_text(root, host or ""))
    return pd.DataFrame({"title": titles, "content": contents})


@F.pandas_udf(T.StringType())
def _title(html: pd.Series) -> pd.Series:
    return pd.Series([page_title(parse(source)) if source else "" for source in html], dtype=object)


# A filter on a deterministic function's result would be pushed below it and parse every page twice.
_article = _article.asNondeterministic()


def with_title(pages: DataFrame) -> DataFrame:
    """Adds the title alone; the article is not looked for."""
    return pages.withColumn("title", _title(F.col("html")))


def with_article(pages: DataFrame, domain: Column | None = None) -> DataFrame:
    """Adds title, content and a 300-character excerpt; domain rules apply where a domain is given."""
    host = domain if domain is not None else F.lit("")
    parsed = pages.withColumn("_article", _article(F.col("html"), host))
    content = F.col("_article.content")
    short = X.trim_ws(F.substring(content, 1, 300))
    return parsed.withColumn("title", F.col("_article.title")).withColumn("content", content).withColumn(
        "excerpt", F.when(F.length(content) > 300, F.concat(short, F.lit("..."))).otherwise(short)
    ).drop("_article")


def link_contents(
    links: DataFrame,
    pages: DataFrame | None = None,
    max_length: int = 5000,
    blocked: tuple[str, ...] = tuple(vocab.BLOCKED_DOMAINS),
    allowed: tuple[str, ...] = (),
) -> DataFrame:
    """What each link post points at: policy errors, or title and content of the stored page.

    Only links that pass the policy reach the HTML parser. `pages` (url, html) is joined by url
    unless the links carry `html` themselves. Links without a host are dropped.
    """
    rows = links.withColumn("host", X.url_host("url")).where(F.col("host") != "").withColumn(
        "domain", F.regexp_replace("host", r"^www\.", "")
    )
    internal = X.is_internal_host("host")
    policy = F.when(internal, F.lit("Blocked: private or internal host")).when(
        ~X.is_domain_allowed("domain", blocked, allowed), F.concat(F.lit("Domain "), F.col("domain"), F.lit(" is blocked"))
    )
    rows = rows.withColumn("error", policy)
    if pages is not None:
        rows = rows.join(pages.select("url", "html"), "url", "left")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("html").isNull(), F.lit("Page not stored"))))
    custom = X.contains_any(F.col("domain"), vocab.CUSTOM_DOMAINS)
    readable = rows.withColumn("html", F.when(F.col("error").isNull(), F.col("html")))
    parsed = readable.withColumn("_a", _article(F.col("html"), F.when(custom, F.col("domain")).otherwise("")))
    content = F.col("_a.content")
    return parsed.select(
        "post_id", "url", "domain", F.col("_a.title").alias("title"),
        F.when(F.length(content) > max_length, F.concat(F.substring(content, 1, max_length), F.lit("..."))).otherwise(content).alias("content"),
        (F.length(content) > max_length).alias("truncated"), "error",
    )


# -- stored discussion pages --------------------------------------------------------------------------------

_SCORES = (".score.unvoted", ".score.likes", ".score.dislikes")
_COMMENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("comment_id", "parent_id", "author", "body")],
    T.StructField("score", T.LongType()), T.StructField("created_at", T.LongType()),
])
_PAGE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("post_id", "title", "author", "content")],
    *[T.StructField(n, T.LongType()) for n in ("score", "num_comments", "created_at")],
    T.StructField("comments", T.ArrayType(_COMMENT)),
])


def _told(element: Element | None) -> str:
    return element.text().strip() if element is not None else ""


def _number(text: str) -> int:
    found = re.search(r"\d+", text)
    return int(found[0]) if found else 0


def _bare_id(element: Element) -> str:
    return re.sub(r"^t[0-9]_", "", element.attrs.get("data-fullname", ""))


def _seconds(element: Element) -> int | None:
    stamp = element.first("time")
    value = stamp.attrs.get("datetime") if stamp is not None else None
    if not value:
        return None
    moment = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def _comment(element: Element, post_id: str) -> dict | None:
    body = _told(element.first(".usertext-body .md"))
    comment_id = _bare_id(element)
    if not comment_id or not body:
        return None
    box = element.closest(".child")
    above = box.closest(".thing.comment") if box is not None else None
    return {
        "comment_id": comment_id, "parent_id": _bare_id(above) if above is not None else post_id,
        "author": _told(element.first(".author")) or "[deleted]", "body": body,
        "score": _number(_told(element.first(*_SCORES))), "created_at": _seconds(element),
    }


@F.pandas_udf(_PAGE)
def _thread_page(html: pd.Series) -> pd.DataFrame:
    rows = []
    for source in html:
        root = parse(source or "")
        head = root.first(".thing.link", ".thing.self")
        if head is None:
            rows.append(dict.fromkeys(
                ("post_id", "title", "author", "content", "score", "num_comments", "created_at", "comments")))
            continue
        post_id = _bare_id(head)
        found = (_comment(e, post_id) for e in root.every(".thing.comment"))
        rows.append({
            "post_id": post_id, "title": _told(head.first(".title a.title", ".title .title")),
            "author": _told(head.first(".author")) or "[deleted]",
            "content": _told(root.first(".usertext-body .md")),
            "score": _number(_told(head.first(*_SCORES))), "num_comments": _number(_told(head.first(".comments"))),
            "created_at": _seconds(head), "comments": [c for c in found if c is not None],
        })
    return pd.DataFrame(rows)


_thread_page = _thread_page.asNondeterministic()


def parse_thread_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored thread pages (permalink, html) to post rows and comment rows.

    A page without a post is left out, as is a comment without id or body.
    """
    parsed = pages.withColumn("p", _thread_page(F.col("html"))).where(F.col("p.post_id").isNotNull())
    subreddit = F.regexp_extract("permalink", r"/r/([a-zA-Z0-9_]+)/", 1)
    posts = parsed.select(
        "p.post_id", subreddit.alias("subreddit"), "p.title", "p.content", "p.author", F.col("permalink").alias("url"),
        "p.score", "p.num_comments", F.timestamp_seconds("p.created_at").alias("created_at"),
    )
    comments = parsed.select("p.post_id", F.explode("p.comments").alias("c")).select(
        "c.comment_id", "post_id", "c.parent_id", "c.author", "c.body", "c.score",
        F.timestamp_seconds("c.created_at").alias("created_at"),
    )
    return posts, comments
