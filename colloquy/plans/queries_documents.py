"""Registered queries: pages, feeds, embeddings, prompts, responses, digests."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import markdown as M
from colloquy.functions import responses as R
from colloquy.functions import text as X
from colloquy.operators import digest as DG
from colloquy.operators import prompts as PR
from colloquy.operators import selection as S
from colloquy.plans import bindings as B
from colloquy.plans import queries_discussion as QD
from colloquy.plans.oracle import with_tables
from colloquy.plans.registry import query
from colloquy.sources import digests as SD
from colloquy.sources import embeddings as E
from colloquy.sources import feeds, pages
from colloquy.session import ensure_checkpoint_dir, materialize

# -- feeds and stored pages -----------------------------------------------------------------------------------

_XML = "replace(replace(replace(title,'&','&amp;'),'<','&lt;'),'>','&gt;')"


@query("a02_feed_entries", with_tables("post", """
SELECT post_id, trim(title) AS title, permalink, author, subreddit FROM (SELECT 'abc' || post_no AS post_id, title, '/r/' || subreddit || '/comments/abc' || post_no || '/' AS permalink, author, subreddit, post_no FROM post)
WHERE post_no % 7 <> 6"""))
def a02(spark, d):
    """Feed entries written from the posts; every seventh points elsewhere and must vanish."""
    n = F.col("post_no")
    escaped = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    where = F.concat(F.lit("https://www.reddit.com/r/"), F.col("subreddit"), F.when(n % 7 == 6, "/wiki/x").otherwise("/comments/abc"), n.cast("string"), F.lit("/some-title/?utm=rss"))
    entry = F.concat(
        F.lit("<entry><author><name>/u/"), F.col("author"), F.lit("</name></author><link href=\""), where, F.lit("\"/><title>"), escaped,
        F.lit("</title><updated>2024-01-05T10:00:00+00:00</updated></entry>"),
    )
    parsed = feeds.parse_feed_column(B.posts(spark, d).select(entry.alias("xml")), "xml", [])
    return parsed.select("post_id", F.trim("title").alias("title"), "permalink", "author", "subreddit")


@query("a04_valid_subreddits", """
SELECT doc_id, count(*) AS n_words, count(*) FILTER (ok) AS n_valid, min(w) FILTER (ok) AS first_valid, max(w) FILTER (NOT ok) AS last_invalid
FROM (SELECT doc_id, w, regexp_matches(w, '^[a-zA-Z0-9][a-zA-Z0-9_]{2,20}$') AS ok FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)) GROUP BY 1""")
def a04(spark, d):
    """Every word of every text as a name."""
    words = B.read_table(spark, d, "documents", spread=True).select("doc_id", F.explode(F.split("text", " ")).alias("name"))
    ok, name = feeds.valid_subreddit(F.col("name")), F.col("name")
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(ok).alias("n_valid"),
        F.min(F.when(ok, name)).alias("first_valid"), F.max(F.when(~ok, name)).alias("last_invalid"),
    )


@query("a03_thread_pages", """
SELECT comment_id, post_id, parent_id, author, body, score FROM (
  SELECT 'm' || conv_id || 'x' || turn AS comment_id, 'k' || conv_id AS post_id,
    CASE WHEN lag(turn) OVER w IS NULL THEN 'k' || conv_id ELSE 'm' || conv_id || 'x' || lag(turn) OVER w END AS parent_id, role AS author,
    regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, turn * 3 AS score
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE body <> ''""")
def a03(spark, d):
    """Conversations written as nested thread pages, read back as comment rows."""
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    opened = F.concat(
        F.lit('<div class="thing comment" data-fullname="t1_m'), conv, F.lit("x"), turn, F.lit('"><a class="author">'), F.col("role"),
        F.lit('</a><span class="score unvoted">'), (F.col("turn") * 3).cast("string"), F.lit(' points</span><div class="usertext-body"><div class="md">'),
        esc, F.lit('</div></div><div class="child">'),
    )
    turns = B.conversations(spark, d).withColumn("opened", opened)
    # A conversation is a handful of turns, so its page is one row.
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "opened"))).alias("t"))
    html = F.concat(
        F.lit('<html><body><div class="thing self" data-fullname="t3_k'), F.col("conv_id").cast("string"),
        F.lit('"><p class="title"><a class="title" href="/x">Talk</a></p><a class="author">op</a></div>'),
        F.array_join(F.transform("t", lambda r: r["opened"]), ""), F.repeat(F.lit("</div></div>"), F.size("t")), F.lit("</body></html>"),
    )
    stored = nested.select(F.lit("/r/talks/comments/k/").alias("permalink"), html.alias("html"))
    _, comments = pages.parse_thread_pages(stored)
    return comments.select("comment_id", "post_id", "parent_id", "author", "body", "score")


_DECODED = "replace(replace(replace(replace(replace({}, '&lt;','<'),'&gt;','>'),'&quot;','\"'),'&amp;','&'),'&#39;','''')"


@query("k08_page_titles", f"""
SELECT page_id, trim({_DECODED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM pages""")
def k08(spark, d):
    return pages.with_title(B.read_table(spark, d, "pages", spread=True)).select("page_id", "title")


_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
#: Title and article text of the given pages, whose content is always one `article` element.
_ARTICLE = """
art AS (SELECT page_id, trim(""" + _PLAIN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + """) AS title,
  trim(regexp_replace(""" + _PLAIN.format("regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')") + """, '\\s+', ' ', 'g')) AS content
  FROM pages)"""


@query("k11_articles", "WITH " + _ARTICLE + """
SELECT page_id, title, content, trim(substr(content, 1, 300)) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END AS excerpt FROM art""")
def k11(spark, d):
    return pages.with_article(B.read_table(spark, d, "pages", spread=True)).select("page_id", "title", "content", "excerpt")


@query("k10_domain_articles", "WITH " + _ARTICLE + """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'own words.' WHEN 4 THEN content ELSE content || ' more.' END AS content FROM art""")
def k10(spark, d):
    """The given pages as they would stand on domains with rules of their own, with parts that the rules drop."""
    n = F.col("page_id") % 5
    # Domains with a container of their own, a container named by id, several containers, and none.
    wrapped = (
        F.when(n == 1, F.concat(F.lit('<div class="readme"><span class="octicon">x</span>'), "inside", F.lit("<p> more.</p></div>")))
        .when(n == 2, F.concat(F.lit('<div id="article-body">'), "inside", F.lit('<p> more.</p></div><div class="crayons-article__body">later</div>')))
        .when(n == 3, F.concat(F.lit('<article><div class="metabar">bar</div>'), "inside", F.lit('<p> more.</p><p class="postActions">act</p></article>')))
        .when(n == 0, F.concat(F.lit('<div class="post-content">own words.</div><article>'), "inside", F.lit("</article>")))
        .otherwise(F.concat(F.lit("<article>"), "inside", F.lit("</article>")))
    )
    domain = F.element_at(F.array(*[F.lit(x) for x in ("news.substack.com", "github.com", "dev.to", "medium.com", "")]), (n + 1).cast("int"))
    rows = B.read_table(spark, d, "pages", spread=True).select(
        "page_id", F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("inside")
    ).select("page_id", domain.alias("domain"), F.concat(F.lit("<html><body><p>x</p>"), wrapped, F.lit("</body></html>")).alias("html"))
    return pages.with_article(rows, F.col("domain")).select("page_id", "content")


@query("k12_allowed_links", with_tables("link", """
SELECT post_id, domain, CASE WHEN h LIKE '169.254.%' OR h LIKE '10.0.0.%' THEN 'Blocked: private or internal host'
  WHEN NOT contains(domain, 'example.org') THEN 'Domain ' || domain || ' is blocked' END AS error
FROM (SELECT *, regexp_replace(h, '^www\\.', '') AS domain FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM link))"""))
def k12_allowed(spark, d):
    """Only one domain and its subdomains may be read."""
    found = pages.link_contents(B.links(spark, d), blocked=(), allowed=("example.org",))
    return found.select("post_id", "domain", "error")


@query("k12_link_policy", with_tables("link", """
SELECT post_id, domain, CASE WHEN h LIKE '169.254.%' OR h LIKE '10.0.0.%' THEN 'Blocked: private or internal host'
  WHEN contains(domain,'twitter.com') OR contains(domain,'x.com') THEN 'Domain ' || domain || ' is blocked' END AS error
FROM (SELECT *, regexp_replace(h, '^www\\.', '') AS domain FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM link))"""))
def k12(spark, d):
    return pages.link_contents(B.links(spark, d)).select("post_id", "domain", "error")


_LINKED = _ARTICLE.strip() + """,
hosts AS (SELECT *, regexp_replace(h, '^www\\.', '') AS domain FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM link)),
linked AS (SELECT post_id, page_id, domain, CASE WHEN h LIKE '169.254.%' OR h LIKE '10.0.0.%' THEN 'Blocked: private or internal host'
  WHEN contains(domain,'twitter.com') OR contains(domain,'x.com') THEN 'Domain ' || domain || ' is blocked' END AS error FROM hosts),
read AS (SELECT linked.*, title, CASE WHEN length(content) > 5000 THEN substr(content, 1, 5000) || '...' ELSE content END AS content, length(content) > 5000 AS truncated
  FROM linked JOIN art USING (page_id))"""


@query("b23_link_prompts", with_tables("link", _LINKED + """
SELECT post_id, CASE WHEN error IS NOT NULL THEN '(Link post - ' || error || ')'
  WHEN length(content) < 50 THEN '(Link post to ' || domain || ' - content extraction failed)'
  ELSE CASE WHEN title <> '' THEN 'Linked Article: "' || title || '"' || chr(10) ELSE '' END || 'Source: ' || domain || chr(10) || chr(10)
    || CASE WHEN length(content) > 1500 THEN substr(content, 1, 1500) || '...' ELSE content END END AS link_text FROM read"""))
def b23(spark, d):
    found = pages.link_contents(B.links(spark, d))
    return found.select("post_id", X.link_prompt("title", "content", "domain", "error", 1500).alias("link_text"))


@query("k12_link_contents", with_tables("link", _LINKED + """
SELECT post_id, title, content, truncated FROM read WHERE error IS NULL"""))
def k12_contents(spark, d):
    return pages.link_contents(B.links(spark, d)).where("error is null").select("post_id", "title", "content", "truncated")


# -- embeddings ----------------------------------------------------------------------------------------------------


@query("a07_backfill_report", with_tables("claim", """
SELECT count(*) AS processed, 0 AS errors FROM claim WHERE NOT has_embedding AND is_canonical"""))
def a07(spark, d):
    return E.backfill_report(E.backfill_embeddings(B.claims(spark, d), E.Embedder(dimensions=64)))


@query("a08_embedding_reuse", with_tables("claim", """
s AS (SELECT claim_id, subject || ' ' || replace(predicate,'-',' ') || ' ' || object AS text, predicate FROM claim)
SELECT claim_id, text IN (SELECT text FROM s WHERE predicate = 'supports') AS cached FROM s"""))
def a08(spark, d):
    """Sentences of `supports` claims are already stored; every other distinct sentence is embedded once."""
    claims = B.claims(spark, d)
    rows = claims.select("claim_id", "predicate", X.claim_sentence("subject", "predicate", "object").alias("text"))
    embedder = E.Embedder(dimensions=32)
    known = rows.where(F.col("predicate") == "supports").select(E.content_key().alias("content_key")).distinct()
    store = known.withColumn("embedding", F.array(F.lit(0.0)).cast("array<float>")).withColumn("model", F.lit(embedder.name))
    embedded, _ = E.embed_with_store(rows, store, embedder)
    return embedded.select("claim_id", "cached")


def _md5_vectors(texts):
    """Unit vectors of word counts; a word's place comes from its MD5."""
    out = np.zeros((len(texts), 16), dtype="float64")
    for row, text in zip(out, texts):
        for word in text.lower().split(" "):
            row[int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % 16] += 1
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


@query("n01_embedded_claims", with_tables("claim", """
w AS (SELECT claim_id, unnest(string_split(lower(subject || ' ' || replace(predicate, '-', ' ') || ' ' || object), ' ')) AS word FROM claim WHERE NOT has_embedding AND is_canonical),
n AS (SELECT claim_id, ('0x' || left(md5(word), 8))::BIGINT % 16 AS place, count(*) AS n FROM w GROUP BY 1, 2)
SELECT claim_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY claim_id)), 5) AS value, 'md5' AS model FROM n"""))
def n01_embedded(spark, d):
    """The places and values that a pluggable embedder gives to every claim without a vector."""
    found = E.backfill_embeddings(B.claims(spark, d), E.Embedder("md5", 16, _md5_vectors))
    parts = found.where("error is null").select("claim_id", "embedding_model", F.posexplode("embedding").alias("place", "value"))
    return parts.where("value > 0").select(
        "claim_id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 5).alias("value"),
        F.col("embedding_model").alias("model"),
    )


# -- prompts and responses --------------------------------------------------------------------------------------------


@query("b21_claim_prompts", with_tables("summary", f"""
SELECT post_id, prompt, CAST(ceil(length(prompt)/4) AS BIGINT) AS input_tokens FROM (SELECT post_id,
 'Find the claims made in the text below.' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Summary: ' || summary || chr(10) || 'Key Topics: ' || array_to_string(key_topics, ', ')
 || chr(10) || 'Sentiment: ' || sentiment || chr(10) || chr(10) || 'Notable Comments:' || chr(10) || CASE post_no % 3 WHEN 1 THEN '' WHEN 2 THEN title ELSE 'On ' || subreddit || chr(10) || title END || chr(10) || chr(10) || '{PR.CLAIMS_REQUEST}' AS prompt FROM summary)"""))
def b21_claims(spark, d):
    """Posts without notable comments, with one and with two."""
    n = F.col("post_no") % 3
    notable = F.when(n == 2, F.array("title")).when(n == 0, F.array(F.concat(F.lit("On "), "subreddit"), F.col("title")))
    rows = B.summaries(spark, d).withColumn("notable_comments", notable)
    return PR.claim_prompts(rows)


_SUMMARY_PROMPT = """,
lines AS (SELECT c.post_id, string_agg('- u/' || author || ' (' || score || ' pts): ' || substr(body, 1, 500), chr(10) ORDER BY pick_no) AS told, count(*) AS shown
  FROM picked JOIN comment c USING (comment_id) GROUP BY 1),
linked AS (SELECT post_id, CASE WHEN length(art.content) < 50 THEN '(Link post to ' || domain || ' - content extraction failed)' ELSE
  CASE WHEN art.title <> '' THEN 'Linked Article: "' || art.title || '"' || chr(10) ELSE '' END || 'Source: ' || domain || chr(10) || chr(10)
  || CASE WHEN length(art.content) > 1500 THEN substr(art.content, 1, 1500) || '...' ELSE art.content END END AS link_text
  FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM post
        WHERE length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 50 AND regexp_matches(url, '^https?://')) p
  JOIN pages USING (url) JOIN art USING (page_id)),
told AS (SELECT post_id, 'Write a summary of the discussion below.' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Author: u/' || author || chr(10)
  || 'Score: ' || score || ' upvotes' || chr(10) || 'URL: ' || url || chr(10) || chr(10) || 'Content:' || chr(10)
  || coalesce(nullif(content, ''), nullif(link_text, ''), '(Link post - no text content)') || chr(10) || chr(10)
  || 'Comments (' || coalesce(shown, 0) || ' of ' || comment_count || ', chosen for different views):' || chr(10) || coalesce(told, '')
  || CASE WHEN controversy_score >= 0.4 THEN chr(10) || chr(10) || 'Opinions differ here (controversy ' || CAST(round(controversy_score*100) AS BIGINT)
     || '%): give every side its share.' ELSE '' END || chr(10) || chr(10) || '""" + PR.SUMMARY_REQUEST + """' AS prompt
  FROM post JOIN detected USING (post_id) LEFT JOIN lines USING (post_id) LEFT JOIN linked USING (post_id))
SELECT post_id, prompt, CAST(ceil(length(prompt)/4) AS BIGINT) AS input_tokens FROM told"""


@query("b21_summary_prompts", with_tables("post tree", QD._DETECT + "," + QD.PICKS + "," + _ARTICLE + _SUMMARY_PROMPT))
def b21(spark, d):
    posts, comments = B.posts(spark, d), B.comments(spark, d)
    detected, _ = QD._detected(spark, d)
    link_rows = posts.where(X.is_link_post("content", "url")).select("post_id", "url")
    texts = pages.link_contents(link_rows, B.read_table(spark, d, "pages")).select(
        "post_id", X.link_prompt("title", "content", "domain", "error", 1500).alias("link_text")
    )
    return PR.summary_prompts(posts, comments, S.diverse_comments(comments, 10), detected, texts)


@query("b22_parsed_responses", """
SELECT doc_id, ok AS parse_ok, NOT ok AS kept_text, CASE WHEN ok THEN text END AS summary,
  CASE WHEN ok THEN (['positive','negative','mixed','neutral'])[1 + doc_id % 4] ELSE 'neutral' END AS sentiment,
  CASE WHEN ok THEN [lang, source] ELSE [] END AS key_topics, CASE WHEN ok THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
  'none' AS controversy_level, 'moderate' AS information_density
FROM (SELECT *, doc_id % 5 <> 4 AND doc_id % 15 NOT IN (5, 10) AS ok FROM documents)""")
def b22(spark, d):
    """Unreadable responses, and those with values of wrong types, become their own summaries."""
    parsed = R.summaries_with_fallback(B.responses(spark, d).select("doc_id", "response_text"), "response_text")
    return parsed.select(
        "doc_id", "parse_ok", (F.col("summary") == F.col("response_text")).alias("kept_text"),
        F.when(F.col("parse_ok"), F.col("summary")).alias("summary"),
        "sentiment", "key_topics", "confidence", "controversy_level", "information_density",
    )


@query("b22_extracted_claims", with_tables("claim", """
SELECT claim_id, 0 AS claim_pos, subject, predicate, object, coalesce(confidence, 0.5) AS confidence, coalesce(source_stance, 'neutral') AS source_stance,
  CASE WHEN coalesce(confidence, 0.5) >= 0.9 THEN 'verified' ELSE 'unverified' END AS verification_status
FROM (SELECT claim_id, subject, predicate, object, CASE WHEN predicate <> 'uses' THEN confidence END AS confidence, CASE WHEN predicate <> 'uses' THEN source_stance END AS source_stance FROM claim)"""))
def b22_claims(spark, d):
    """Each claim written as a fenced response and read back; `uses` claims leave the optional fields out."""
    claims = B.claims(spark, d)
    given = lambda name: F.when(F.col("predicate") != "uses", F.col(name)).alias(name)
    body = F.to_json(F.struct(F.array(F.struct("subject", "predicate", "object", given("confidence"), given("source_stance"))).alias("claims")))
    told = claims.select("claim_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response_text"))
    return R.claims_from_responses(told, "response_text", ["claim_id"])


@query("b25_typed_responses", """
SELECT doc_id, kind, CASE kind WHEN 'story' THEN doc_id % 3 <> 0 WHEN 'verdict' THEN doc_id % 11 <= 10 WHEN 'what_matters' THEN doc_id % 9 <= 6 WHEN 'notable_threads' THEN doc_id % 9 <= 4
  WHEN 'ranking' THEN doc_id % 150 <= 100 ELSE true END AS parse_ok
FROM documents, (SELECT unnest(['story','verdict','what_matters','notable_threads','ranking','theme_label','theme_synthesis','controversy_summary']) AS kind)""")
def b25(spark, d):
    """Every response type over all documents, some with broken rules (missing field, too many items, out of range)."""
    docs = B.read_table(spark, d, "documents")
    n = F.col("doc_id")
    repeat = lambda item, times: F.transform(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")), lambda i: item)
    few = F.when(n % 9 == 0, F.lit(1)).otherwise(n % 9)
    text = F.col("text")
    bodies = {
        "story": F.struct(F.when(n % 3 != 0, text).alias("narrative"), F.col("lang").alias("hook")),
        "verdict": F.struct((n % 2 == 0).alias("isContradiction"), ((n % 11) / 10).alias("confidence"), text.alias("explanation"), F.lit("direct").alias("contradictionType")),
        "what_matters": F.struct(repeat(F.struct(F.lit("urgent").alias("priority"), F.col("source").alias("topic"), text.alias("impact"), F.struct(F.col("lang").alias("community")).alias("status")), few).alias("items")),
        "notable_threads": F.struct(repeat(F.struct(F.lit("u").alias("thread_author"), text.alias("insight"), F.lit("debate").alias("thread_type")), few).alias("notable_threads")),
        "ranking": F.struct(F.array(F.struct(F.col("source").alias("post_id"), (n % 150).alias("importance_score"))).alias("rankings")),
        "theme_label": F.struct(F.col("source").alias("name"), text.alias("description"), F.array("lang").alias("keywords")),
        "theme_synthesis": F.struct(F.array(F.struct(text.alias("trend"), F.array("lang").alias("evidence"), F.lit(0.5).alias("confidence"))).alias("emerging_trends")),
        "controversy_summary": F.struct(text.alias("summary"), F.struct(text.alias("main_claim"), text.alias("balanced_summary")).alias("controversy_analysis")),
    }
    rows = docs.select("doc_id", *[F.to_json(body).alias(f"{kind}_text") for kind, body in bodies.items()])
    for kind in bodies:
        rows = R.parse_responses(rows, f"{kind}_text", R.SPECS[kind], into=kind)
    told = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}.parse_ok").alias("parse_ok")) for kind in bodies])
    return rows.select("doc_id", F.explode(told).alias("t")).select("doc_id", "t.kind", "t.parse_ok")


# -- rendered responses -----------------------------------------------------------------------------------------------

_ESC = "replace(replace(replace(replace({},'<','&lt;'),'>','&gt;'),'[','\\['),']','\\]')"
_CELL = "replace(" + _ESC + ",'|','\\|')"


def _cut55(column: str) -> str:
    head = f"substr({column},1,55)"
    space = f"(CASE WHEN instr(reverse({head}),' ') = 0 THEN -1 ELSE length({head}) - instr(reverse({head}),' ') END)"
    return f"CASE WHEN length({column}) <= 55 THEN {column} WHEN {space} > 38.5 THEN substr({column},1,{space}) || '...' ELSE {head} || '...' END"


@query("m03_rendered_responses", f"""
SELECT doc_id,
 '## Today''s Themes' || chr(10) || chr(10) || '### ' || {_ESC.format('lang')} || chr(10) || chr(10) || {_ESC.format('text')} || chr(10) || chr(10) || '**Discussed in:**' || chr(10)
  || '- ' || {_ESC.format('source')} || chr(10) || '- b[1]'.replace('[','\\[').replace(']','\\]') || chr(10) || chr(10) || '## Emerging Patterns' || chr(10) || chr(10)
  || '- **' || {_ESC.format('source')} || '** (67% confidence)' || chr(10) || '  - Evidence: ' || {_ESC.format('lang')} || '; x' || chr(10) AS themes,
 '## What Matters Today' || chr(10) || chr(10) || '| Priority | Topic | Impact | Status |' || chr(10) || '|:--------:|-------|--------|--------|' || chr(10)
  || '| 🔴 | ' || {_CELL.format('source')} || ' | ' || {_CELL.format('(' + _cut55('text') + ')')} || ' | Community: ' || {_CELL.format('lang')}
  || CASE WHEN doc_id % 2 = 0 THEN ' / Official: yes\\|no' ELSE '' END || ' |' || chr(10) || chr(10) || '**Priority**: 🔴 Urgent · 🟡 Developing · 🟢 Informational' || chr(10) AS matters,
 '**Notable Threads:**' || chr(10) || '- 💡 ' || text || CASE WHEN doc_id % 2 = 0 THEN ' *(' || lang || ')*' ELSE '' END AS threads,
 CASE WHEN doc_id % 2 = 0 THEN '**The Story:** *' || source || '*' || chr(10) || chr(10) || text ELSE '**The Story:** ' || text END AS story,
 '**Main Claim:** ' || source || chr(10) || chr(10) || '**Supporting Arguments:**' || chr(10) || '- ' || text || chr(10) || chr(10) || '**Community Split:**' || chr(10)
  || '- **' || lang || '** (~60%): ' || source || chr(10) AS analysis,
 text || chr(10) || chr(10) || '**Key Discussion Threads:**' || chr(10) || '- *u/' || source || '* (3 participants): ' || lang || chr(10) AS summaries
FROM documents""")
def m03(spark, d):
    docs = B.read_table(spark, d, "documents")
    even = F.col("doc_id") % 2 == 0
    s = lambda value, name: (F.lit(value) if not hasattr(value, "alias") else value).alias(name)
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")
    strings = F.array().cast("array<string>")
    themes = F.array(F.struct(s(lang, "theme"), s(F.array(source, F.lit("b[1]")), "posts"), s(text, "summary")))
    conflict_type = "array<struct<topic:string,viewpoint_a:struct<position:string,sources:array<string>>,viewpoint_b:struct<position:string,sources:array<string>>>>"
    trends = F.array(F.struct(s(source, "trend"), s(F.array(lang, F.lit("x")), "evidence"), s(0.665, "confidence")))
    status = F.struct(s(lang, "community"), s(F.when(even, "yes|no"), "official"))
    items = F.array(F.struct(s("urgent", "priority"), s(source, "topic"), s(text, "impact"), s(status, "status")))
    threads = F.array(F.struct(s("insight", "thread_type"), s(text, "insight"), s(F.when(even, lang), "engagement_signal")))
    analysis = F.struct(
        s(source, "main_claim"), s(F.array(text), "supporting_points"), s(strings, "opposing_points"),
        s(F.array(F.struct(s(lang, "camp_name"), s(60.0, "percentage"), s(source, "key_argument"))), "community_split"), s(strings, "nuances"),
    )
    talks = F.array(F.struct(s(source, "author"), s(3, "participants"), s(lang, "summary")))
    return docs.select(
        "doc_id", M.theme_synthesis(themes, F.array().cast(conflict_type), trends).alias("themes"), M.what_matters(items).alias("matters"),
        M.notable_threads(threads).alias("threads"), M.story(text, F.when(even, source)).alias("story"),
        M.controversy_analysis(analysis).alias("analysis"), M.thread_summaries(text, talks).alias("summaries"),
    )


# -- digests ---------------------------------------------------------------------------------------------------------------


def _ranked(spark, d):
    return S.rank_posts(S.score_posts(B.summaries(spark, d)))


_MORE = """,
best AS (SELECT post_id, subject || ' ' || replace(predicate,'-',' ') || ' ' || object AS t, confidence, row_number() OVER (PARTITION BY post_id ORDER BY extracted_at, claim_id) AS k FROM claim WHERE confidence >= 0.8),
lists AS (SELECT post_id, '**High-Confidence Claims:**' || chr(10) || string_agg('- ' || CASE WHEN confidence >= 0.9 THEN '✓' ELSE '?' END || ' ' || t || ' (' || CAST(floor(confidence*100+0.5) AS BIGINT) || '%)' || chr(10), '' ORDER BY k) || chr(10) AS claims
  FROM best WHERE k <= 3 GROUP BY 1),
full_rows AS (SELECT *, coalesce(claims, '') AS block, replace(replace(replace(replace(title,'<','&lt;'),'>','&gt;'),'[','\\['),']','\\]') AS safe_title,
  CAST(floor(confidence*100 + 0.5) AS BIGINT) AS pct FROM ranked LEFT JOIN lists USING (post_id))"""


@query("m01_top_discussions", with_tables("summary claim", QD._RANKED + _MORE + """
SELECT digest_date, importance_rank AS ord, '### [' || safe_title || '](' || url || ') • r/' || subreddit || chr(10) || '**Score: ' || score || ' • Confidence: ' || pct || '%**'
  || CASE controversy_level WHEN 'high' THEN ' • Controversy: High' WHEN 'medium' THEN ' • Controversy: Medium' WHEN 'low' THEN ' • Controversy: Low' ELSE '' END
  || chr(10) || chr(10) || block || '---' || chr(10) || chr(10) AS markdown
FROM full_rows WHERE NOT is_low_activity AND importance_rank <= 6"""))
def m01(spark, d):
    fragments = DG.digest_fragments(_ranked(spark, d), B.claims(spark, d))
    body = fragments.where((F.col("section") == DG.DISCUSSIONS) & (F.col("part") == DG.BODY))
    return body.select("digest_date", "ord", "markdown")


@query("m01_posts_by_subreddit", with_tables("summary claim", QD._RANKED + _MORE + """
SELECT digest_date, subreddit AS grp, importance_rank AS ord, '### [' || safe_title || '](' || url || ') {#' || substr(regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'(^-|-$)','','g'),1,50)
  || '}' || chr(10) || chr(10) || '**' || score || '↑** • ' || num_comments || ' comments • ' || pct || '% confidence'
  || CASE controversy_level WHEN 'high' THEN ' • ⚠️ **Controversial**' WHEN 'medium' THEN ' • ⚡ Debate' ELSE '' END || chr(10) || chr(10)
  || replace(replace(replace(replace(summary,'<','&lt;'),'>','&gt;'),'[','\\['),']','\\]') || chr(10) || chr(10)
  || CASE WHEN confidence < 0.75 THEN '> ⚠️ **Missing context:** ' || missing_context[1] || ', dates &lt;unclear&gt;' || chr(10) || chr(10) ELSE '' END || block || '---' || chr(10) || chr(10) AS markdown
FROM full_rows WHERE NOT is_low_activity"""))
def m01_subreddits(spark, d):
    fragments = DG.digest_fragments(_ranked(spark, d), B.claims(spark, d))
    body = fragments.where((F.col("section") == DG.BY_SUBREDDIT) & (F.col("part") == DG.BODY))
    return body.select("digest_date", "grp", "ord", "markdown")


@query("m02_digest_outline", with_tables("summary claim", QD._RANKED + """,
busy AS (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY importance_rank, post_id) AS n FROM ranked WHERE NOT is_low_activity),
f AS (SELECT DISTINCT digest_date, 0 AS section, '' AS grp, 0 AS ord, 1 AS part FROM ranked
 UNION ALL SELECT DISTINCT digest_date, 1, '', -1, 0 FROM busy UNION ALL SELECT DISTINCT digest_date, 1, chr(1114111), 4611686018427387904, 2 FROM busy
 UNION ALL SELECT digest_date, 1, '', n, 1 FROM busy WHERE n <= 6 UNION ALL SELECT DISTINCT digest_date, 4, '', 0, 1 FROM ranked
 UNION ALL SELECT DISTINCT digest_date, 5, '', -1, 0 FROM busy WHERE importance_rank <= 6 UNION ALL SELECT digest_date, 5, '', importance_rank, 1 FROM busy WHERE importance_rank <= 6
 UNION ALL SELECT DISTINCT digest_date, 6, subreddit, -1, 0 FROM busy UNION ALL SELECT digest_date, 6, subreddit, importance_rank, 1 FROM busy
 UNION ALL SELECT DISTINCT digest_date, 7, '', -1, 0 FROM ranked WHERE is_low_activity UNION ALL SELECT DISTINCT digest_date, 7, chr(1114111), 4611686018427387904, 2 FROM ranked WHERE is_low_activity
 UNION ALL SELECT digest_date, 7, '', importance_rank, 1 FROM ranked WHERE is_low_activity)
SELECT digest_date, row_number() OVER (PARTITION BY digest_date ORDER BY section, grp, ord, part) AS place, section FROM f"""))
def m02(spark, d):
    fragments = DG.digest_fragments(_ranked(spark, d), B.claims(spark, d))
    order = [F.asc("section"), F.asc("grp"), F.asc("ord"), F.asc("part")]
    return DG.row_numbers(fragments, ["digest_date"], order, "place").select("digest_date", "place", "section")


_TOLD = """
told AS (SELECT *, CASE WHEN post_no % 4 = 1 THEN '  Told in [' || title || '] ' END AS narrative, CASE WHEN post_no % 8 = 1 THEN subreddit || ' <hook>' END AS hook,
  post_no % 5 = 2 AS talked FROM full_rows),
blocks AS (SELECT *, """ + _ESC.format("trim(narrative)") + """ AS safe_told, """ + _ESC.format("narrative") + """ AS safe_narrative, """ + _ESC.format("hook") + """ AS safe_hook,
  CASE WHEN talked THEN '**Notable Threads:**' || chr(10) || '- ⚔️ On ' || safe_title || chr(10) || '- • ' || """ + _ESC.format("subreddit") + """ || chr(10) || chr(10) ELSE '' END AS thread_block,
  regexp_replace(CASE WHEN regexp_extract(summary,'^[^.!?]+[.!?]') <> '' THEN regexp_extract(summary,'^[^.!?]+[.!?]')
   ELSE string_split_regex(summary,'[.!?]')[1] END, '^\\s+|\\s+$', '', 'g') AS sentence FROM told),
texts AS (SELECT *, """ + _ESC.format("CASE WHEN length(sentence) <= 80 THEN sentence ELSE substr(sentence,1,77) || '...' END") + """ AS impact,
  row_number() OVER (PARTITION BY digest_date, is_low_activity ORDER BY importance_rank, post_id) AS place FROM blocks),
counts AS (SELECT digest_date, count(*) AS posts, count(DISTINCT subreddit) AS subs, sum(coalesce(n, 0)) AS claims, count(*) FILTER (is_low_activity) AS low,
  count(*) FILTER (NOT is_low_activity) AS busy, count(*) FILTER (NOT is_low_activity AND importance_rank <= 6) AS top
  FROM texts LEFT JOIN (SELECT post_id, count(*) AS n FROM claim GROUP BY 1) USING (post_id) GROUP BY 1),
f AS (
  SELECT digest_date, 0 AS section, '' AS grp, 0 AS ord, 1 AS part, '# Daily Digest - ' || digest_date || chr(10) || chr(10) || '*' || dayname(digest_date) || ', ' || monthname(digest_date) || ' '
    || day(digest_date) || ', ' || year(digest_date) || ' • ' || posts || ' posts • ' || subs || ' subreddits • ' || claims || ' claims extracted*' || chr(10) || chr(10) AS markdown FROM counts
  UNION ALL SELECT digest_date, 1, '', -1, 0, '## What Matters' || chr(10) || chr(10) || '| Topic | Impact | Status |' || chr(10) || '|-------|--------|--------|' || chr(10) FROM counts WHERE busy > 0
  UNION ALL SELECT digest_date, 1, '', place, 1, '| ' || CASE WHEN importance_score >= 70 OR controversy_level = 'high' OR sentiment = 'negative' THEN '🔴'
    WHEN importance_score >= 45 OR controversy_level = 'medium' OR sentiment = 'mixed' THEN '🟡' ELSE '🟢' END || ' **' || safe_title || '** | ' || impact || ' | ' || sentiment || ' |' || chr(10)
    FROM texts WHERE NOT is_low_activity AND place <= 6
  UNION ALL SELECT digest_date, 1, chr(1114111), 4611686018427387904, 2, chr(10) || '**Note:** 🔴 Urgent • 🟡 Developing • 🟢 Informational' || chr(10) || chr(10) || '---' || chr(10) || chr(10) FROM counts WHERE busy > 0
  UNION ALL SELECT digest_date, 2, '', 0, 1, '## Today''s Themes' || chr(10) || chr(10) || '### ' || """ + _ESC.format("subreddit") + """ || chr(10) || chr(10) || """ + _ESC.format("summary") + """ || chr(10) || chr(10)
    || '**Discussed in:**' || chr(10) || '- ' || safe_title || chr(10) || chr(10) FROM texts WHERE importance_rank = 1
  UNION ALL SELECT digest_date, 3, '', 0, 1, '## Contradictions' || chr(10) || chr(10) || string_agg('- ' || safe_title || chr(10), '' ORDER BY importance_rank) || chr(10)
    FROM texts WHERE importance_rank <= 5 AND controversy_level = 'high' GROUP BY 1
  UNION ALL SELECT digest_date, 4, '', 0, 1, '---' || chr(10) || chr(10) FROM counts
  UNION ALL SELECT digest_date, 5, '', -1, 0, '## Top Discussions' || chr(10) || chr(10) FROM counts WHERE top > 0
  UNION ALL SELECT digest_date, 5, '', importance_rank, 1, '### [' || safe_title || '](' || url || ') • r/' || """ + _ESC.format("subreddit") + """ || chr(10) || '**Score: ' || score || ' • Confidence: ' || pct || '%**'
    || CASE controversy_level WHEN 'high' THEN ' • Controversy: High' WHEN 'medium' THEN ' • Controversy: Medium' WHEN 'low' THEN ' • Controversy: Low' ELSE '' END || chr(10) || chr(10)
    || coalesce('**The Story:**' || chr(10) || safe_told || chr(10) || chr(10), '') || thread_block || block || '---' || chr(10) || chr(10) FROM texts WHERE NOT is_low_activity AND importance_rank <= 6
  UNION ALL SELECT DISTINCT digest_date, 6, subreddit, -1, 0, '## r/' || """ + _ESC.format("subreddit") + """ || chr(10) || chr(10) FROM texts WHERE NOT is_low_activity
  UNION ALL SELECT digest_date, 6, subreddit, importance_rank, 1, '### [' || safe_title || '](' || url || ') {#' || substr(regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'(^-|-$)','','g'),1,50)
    || '}' || chr(10) || chr(10) || '**' || score || '↑** • ' || num_comments || ' comments • ' || pct || '% confidence'
    || CASE controversy_level WHEN 'high' THEN ' • ⚠️ **Controversial**' WHEN 'medium' THEN ' • ⚡ Debate' ELSE '' END || chr(10) || chr(10)
    || CASE WHEN narrative IS NULL THEN '' WHEN hook IS NOT NULL THEN '**The Story:** *' || safe_hook || '*' || chr(10) || chr(10) || safe_narrative || chr(10) || chr(10)
       ELSE '**The Story:** ' || safe_narrative || chr(10) || chr(10) END
    || """ + _ESC.format("summary") + """ || chr(10) || chr(10)
    || CASE WHEN confidence < 0.75 THEN '> ⚠️ **Missing context:** ' || missing_context[1] || ', dates &lt;unclear&gt;' || chr(10) || chr(10) ELSE '' END
    || thread_block || block || '---' || chr(10) || chr(10) FROM texts WHERE NOT is_low_activity
  UNION ALL SELECT digest_date, 7, '', -1, 0, '## Low-Activity Posts' || chr(10) || chr(10) || '<details>' || chr(10) || '<summary>'
    || CASE WHEN low = 1 THEN '1 post' ELSE low || ' posts' END || ' with limited discussion</summary>' || chr(10) || chr(10) FROM counts WHERE low > 0
  UNION ALL SELECT digest_date, 7, '', importance_rank, 1, '### [' || safe_title || '](' || url || ') • r/' || """ + _ESC.format("subreddit") + """ || ' • Score: ' || score
    || CASE WHEN confidence < 0.75 THEN ' • ⚠️ Low confidence' ELSE '' END || chr(10) || CASE WHEN impact <> '' THEN impact || chr(10) ELSE '' END || chr(10) FROM texts WHERE is_low_activity
  UNION ALL SELECT digest_date, 7, chr(1114111), 4611686018427387904, 2, '</details>' || chr(10) || chr(10) FROM counts WHERE low > 0),
doc AS (SELECT digest_date, row_number() OVER (PARTITION BY digest_date ORDER BY section, grp, ord, part) AS place, section, markdown FROM f)"""


def _whole_digests(spark, d):
    """Fragments of digests that have every section, and posts with stories and threads."""
    n, title = F.col("post_no"), F.col("title")
    kind = "array<struct<type:string,insight:string>>"
    thread = lambda of, insight: F.struct(F.lit(of).alias("type"), insight.alias("insight"))
    ranked = _ranked(spark, d).withColumns({
        "story_narrative": F.when(n % 4 == 1, F.concat(F.lit("  Told in ["), title, F.lit("] "))),
        "story_hook": F.when(n % 8 == 1, F.concat("subreddit", F.lit(" <hook>"))),
        "threads": F.when(n % 5 == 2, F.array(thread("debate", F.concat(F.lit("On "), title)), thread("other", F.col("subreddit")))).cast(kind),
    })
    theme = F.array(F.struct(F.col("subreddit").alias("theme"), F.array("title").alias("posts"), F.col("summary").alias("summary")))
    none = F.array().cast("array<struct<topic:string,viewpoint_a:struct<position:string,sources:array<string>>,viewpoint_b:struct<position:string,sources:array<string>>>>")
    trends = F.array().cast("array<struct<trend:string,evidence:array<string>,confidence:double>>")
    themes = ranked.where("importance_rank = 1").select(
        "digest_date", F.concat(M.theme_synthesis(theme, none, trends), F.lit("\n")).alias("markdown")
    )
    # Five rows per date at most.
    heated = ranked.where("importance_rank <= 5 and controversy_level = 'high'").groupBy("digest_date").agg(
        F.array_sort(F.collect_list(F.struct("importance_rank", X.escape_markdown("title").alias("title")))).alias("posts")
    )
    lines = F.array_join(F.transform("posts", lambda p: F.concat(F.lit("- "), p["title"], F.lit("\n"))), "")
    contradictions = heated.select("digest_date", F.concat(F.lit("## Contradictions\n\n"), lines, F.lit("\n")).alias("markdown"))
    return DG.digest_fragments(ranked, B.claims(spark, d), themes=themes, contradictions=contradictions)


@query("m02_digest_documents", with_tables("summary claim", QD._RANKED + _MORE + "," + _TOLD + " SELECT digest_date, place, markdown FROM doc"))
def m02_documents(spark, d):
    """Every fragment of every digest in document order, all sections included."""
    return DG.numbered_fragments(_whole_digests(spark, d))


@query("a05_written_digests", with_tables("summary claim", QD._RANKED + _MORE + "," + _TOLD + """,
lines AS (SELECT digest_date, place, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM (SELECT digest_date, place, string_split(regexp_replace(markdown, '\n$', ''), chr(10)) AS l FROM doc))
SELECT digest_date, row_number() OVER (PARTITION BY digest_date ORDER BY place, k) AS line_no, line FROM lines"""))
def a05(spark, d):
    """Digests published twice, the second time whole, and the lines of what readers then find."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/digests-{uuid.uuid4().hex}"
    fragments = materialize(_whole_digests(spark, d))
    SD.publish_digests(fragments.where(F.col("section") == DG.HEADER), path, "run1")
    SD.publish_digests(fragments, path, "run2")
    return SD.read_digests(spark, path)


@query("a06_digest_range", with_tables("summary", """
SELECT CAST(r.d AS DATE) AS digest_date, count(post_id) AS posts FROM (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-02-03', INTERVAL 1 DAY)) AS d) r
LEFT JOIN summary ON digest_date = CAST(r.d AS DATE) GROUP BY 1"""))
def a06(spark, d):
    days = SD.digest_range(spark, dt.date(2024, 1, 5), dt.date(2024, 2, 3))
    return days.join(B.summaries(spark, d), "digest_date", "left").groupBy("digest_date").agg(F.count("post_id").alias("posts"))


# -- entities ---------------------------------------------------------------------------------------------------------


@query("b19_entities", "SELECT doc_id, text FROM documents")
def b19(spark, d):
    """Every text with its marks written as entities of all three forms, and read back."""
    coded = F.col("text")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ("|", "&#x7C;"), ("%", "&#37;")):
        coded = F.replace(coded, F.lit(mark), F.lit(entity))
    return B.read_table(spark, d, "documents", spread=True).select("doc_id", X.decode_entities(coded).alias("text"))
