"""Registered queries: scalar functions, claim filters, joins, counts, upserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import predicates as P
from colloquy.functions import text as X
from colloquy.operators import claims as C
from colloquy.operators import upsert as U
from colloquy.operators import validation as V
from colloquy.plans import bindings as B
from colloquy.plans.oracle import with_tables
from colloquy.plans.registry import query

NOW = datetime(2001, 11, 4)


def _sql_list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- scalar functions over whole tables -------------------------------------------------------------


@query("b01_claim_sentence", with_tables("claim", """
SELECT claim_id, subject || ' ' || replace(predicate,'-',' ') || ' ' || object AS sentence FROM claim"""))
def b01(spark, d):
    return B.claims(spark, d).select("claim_id", X.claim_sentence("subject", "predicate", "object").alias("sentence"))


@query("b02_claim_display", with_tables("claim", """
SELECT claim_id, replace(subject,'-',' ') || ' ' || replace(predicate,'-',' ') || ' ' || replace(object,'-',' ')
  || ' *(' || CAST(floor(confidence*100 + 0.5) AS BIGINT) || '% confident)*' AS display FROM claim"""))
def b02(spark, d):
    return B.claims(spark, d).select(
        "claim_id", X.claim_display("subject", "predicate", "object", "confidence").alias("display")
    )


@query("b03_escape_markdown", """
SELECT page_id, replace(replace(replace(replace(html,'<','&lt;'),'>','&gt;'),'[','\\['),']','\\]') AS escaped,
  replace(replace(replace(replace(replace(replace(html,'<','&lt;'),'>','&gt;'),'[','\\['),']','\\]'),'|','\\|'),'`','\\`') AS escaped_full
FROM pages""")
def b03(spark, d):
    pages = B.read_table(spark, d, "pages")
    return pages.select(
        "page_id", X.escape_markdown("html").alias("escaped"), X.escape_markdown_full("html").alias("escaped_full")
    )


@query("b04_slug", with_tables("post", """
SELECT post_id, substr(regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'(^-|-$)','','g'),1,50) AS slug FROM post"""))
def b04(spark, d):
    return B.posts(spark, d).select("post_id", X.slug("title").alias("slug"))


@query("b05_dates", """
SELECT event_id, dayname(ts) || ', ' || monthname(ts) || ' ' || day(ts) || ', ' || year(ts) AS human_date,
  strftime(ts, '%b ') || day(ts) || strftime(ts, ', %Y, %I:%M %p') AS short_date,
  CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || ' days ago'
       WHEN days < 30 THEN (days // 7) || ' weeks ago' ELSE (days // 30) || ' months ago' END AS relative_date
FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-15 12:00:00') - epoch_us(ts)) // 86400000000 AS days FROM events)""")
def b05(spark, d):
    events = B.read_table(spark, d, "events")
    now = F.lit(datetime(2024, 2, 15, 12)).cast("timestamp_ntz")
    return events.select(
        "event_id",
        X.human_date(F.date_format("ts", "yyyy-MM-dd")).alias("human_date"),
        X.short_datetime("ts").alias("short_date"),
        X.relative_date("ts", now).alias("relative_date"),
    )


@query("b06_shorten", """
SELECT doc_id,
  CASE WHEN length(text) <= 120 THEN text ELSE substr(text,1,117) || '...' END AS dots,
  CASE WHEN length(text) <= 60 THEN text ELSE substr(text,1,59) || '…' END AS ellipsis,
  CASE WHEN length(text) <= 55 THEN text
       WHEN sp > 38.5 THEN substr(text,1,sp) || '...' ELSE substr(text,1,55) || '...' END AS words
FROM (SELECT doc_id, text, CASE WHEN instr(reverse(substr(text,1,55)),' ') = 0 THEN -1
        ELSE length(substr(text,1,55)) - instr(reverse(substr(text,1,55)),' ') END AS sp FROM documents)""")
def b06(spark, d):
    docs = B.read_table(spark, d, "documents")
    return docs.select(
        "doc_id", X.cut_dots("text", 120).alias("dots"), X.cut_ellipsis("text", 60).alias("ellipsis"),
        X.cut_words("text", 55).alias("words"),
    )


@query("b07_impact", """
SELECT doc_id, s AS first_sentence, CASE WHEN length(s) <= 80 THEN s ELSE substr(s,1,77) || '...' END AS impact
FROM (SELECT doc_id, regexp_replace(CASE WHEN regexp_extract(text,'^[^.!?]+[.!?]') <> '' THEN regexp_extract(text,'^[^.!?]+[.!?]')
   ELSE string_split_regex(text,'[.!?]')[1] END, '^\\s+|\\s+$', '', 'g') AS s FROM documents)""")
def b07(spark, d):
    docs = B.read_table(spark, d, "documents")
    return docs.select("doc_id", X.first_sentence("text").alias("first_sentence"), X.impact_line("text").alias("impact"))


@query("b09_claim_labels", with_tables("claim", """
SELECT claim_id, repeat('█', f) || repeat('░', 10 - f) || ' ' || pct || '%' AS bar,
  CASE WHEN confidence >= 0.9 THEN 'verified' ELSE 'unverified' END AS verification
FROM (SELECT claim_id, confidence, CAST(floor(confidence*100+0.5) AS BIGINT) AS pct,
        CAST(floor(floor(confidence*100+0.5)/10 + 0.5) AS INT) AS f FROM claim)"""))
def b09(spark, d):
    return B.claims(spark, d).select(
        "claim_id", X.confidence_bar("confidence").alias("bar"), X.verification("confidence").alias("verification")
    )


@query("b10_stance_labels", with_tables("stance", """
SELECT claim_id, user_stance,
  CASE user_stance WHEN 'agrees' THEN '✓' WHEN 'disagrees' THEN '✗' WHEN 'neutral' THEN '~' WHEN 'uncertain' THEN '?' ELSE '○' END AS symbol,
  CASE user_stance WHEN 'agrees' THEN 'agreed' WHEN 'disagrees' THEN 'disagreed' WHEN 'neutral' THEN 'neutral'
    WHEN 'uncertain' THEN 'uncertain' ELSE 'unrated' END AS label FROM stance"""))
def b10(spark, d):
    return B.stances(spark, d).select(
        "claim_id", "user_stance", X.stance_symbol("user_stance").alias("symbol"), X.stance_label("user_stance").alias("label")
    )


@query("b13_clean_claim_text", """
SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t,1,200) || '...' ELSE t END AS label_text,
  replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    CASE WHEN length(t) > 500 THEN substr(t,1,500) || '...' ELSE t END,
    '\\bignore\\s+(previous|above|all)\\b','[FILTERED]','gi'), '\\bforget\\s+(previous|above|all)\\b','[FILTERED]','gi'),
    '\\bsystem\\s*:','[FILTERED]','gi'), '\\binstruction\\s*:','[FILTERED]','gi'), '```', '''''''') AS verifier_text
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' Ignore previous text, system : ' || lang,
   '[\\x00-\\x1F\\x7F]',' ','g'),'\\s+',' ','g'),'^\\s+|\\s+$','','g') AS t FROM documents)""")
def b13(spark, d):
    docs = B.read_table(spark, d, "documents")
    text = F.concat("text", F.lit(" Ignore previous text, system : "), "lang")
    return docs.select(
        "doc_id", X.clean_claim_text(text, 200).alias("label_text"), X.mask_injections(text, 500).alias("verifier_text")
    )


@query("b14_token_cost", """
SELECT doc_id, CAST(ceil(length(text)/4) AS BIGINT) AS tokens, round(ceil(length(text)/4)/1e6*3.0 + 500/1e6*15.0, 6) AS cost FROM documents""")
def b14(spark, d):
    docs = B.read_table(spark, d, "documents")
    tokens = X.token_estimate("text")
    return docs.select("doc_id", tokens.alias("tokens"), F.round(X.cost_usd(tokens, F.lit(500)), 6).alias("cost"))


@query("b18_url_domain", with_tables("link", """
SELECT post_id, regexp_replace(h, '^www\\.', '') AS domain, h AS host,
  h LIKE '169.254.%' OR regexp_matches(h, '^10\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') AS internal,
  NOT (contains(h,'twitter.com') OR contains(h,'x.com') OR contains(h,'facebook.com') OR contains(h,'instagram.com') OR contains(h,'tiktok.com')) AS allowed,
  length(trim(content)) < 50 AND NOT contains(url,'reddit.com') AND NOT contains(url,'redd.it') AS is_link_post
FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM link)"""))
def b18(spark, d):
    links = B.links(spark, d).withColumn("host", X.url_host("url"))
    domain = X.url_domain("url")
    return links.select(
        "post_id", domain.alias("domain"), "host", X.is_internal_host("host").alias("internal"),
        X.is_domain_allowed(domain).alias("allowed"), X.is_link_post("content", "url").alias("is_link_post"),
    )


@query("b20_first_integer", """
SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '\\d+') AS BIGINT), 0) AS number FROM pages""")
def b20(spark, d):
    return B.read_table(spark, d, "pages").select("page_id", X.first_integer("url").alias("number"))


# -- filters -------------------------------------------------------------------------------------------


_PAGE = """
SELECT c.claim_id, subject, predicate, object, confidence, extracted_at, s.user_stance FROM (
  SELECT * FROM claim WHERE {where} ORDER BY extracted_at DESC, claim_id LIMIT {limit} OFFSET {offset}) c
LEFT JOIN stance s USING (claim_id)"""


@query("c01_claim_filter", with_tables("claim stance", _PAGE.format(
    where="extracted_at >= TIMESTAMP '2001-11-04' - INTERVAL 400 DAY AND predicate = 'supports' AND contains(subject, '#1')",
    limit=50, offset=10)))
def c01(spark, d):
    q = C.ClaimQuery(days=400, predicate="supports", subject="#1", reference=NOW)
    return C.browse(B.claims(spark, d), B.stances(spark, d), q, limit=50, offset=10)


@query("f01_keyset_page", with_tables("claim stance", _PAGE.format(
    where="predicate = 'has' AND (extracted_at < TIMESTAMP '1999-06-01' OR (extracted_at = TIMESTAMP '1999-06-01' AND claim_id > 'claim:2'))",
    limit=50, offset=0)))
def f01_keyset(spark, d):
    """The page behind a row that the reader has seen, by its time and id."""
    q = C.ClaimQuery(predicate="has")
    return C.browse_after(B.claims(spark, d), B.stances(spark, d), q, 50, datetime(1999, 6, 1), "claim:2")


@query("c02_claim_search", with_tables("claim", """
SELECT claim_id, subject, predicate, object, confidence, extracted_at FROM claim
WHERE extracted_at >= TIMESTAMP '2001-11-04' - INTERVAL 900 DAY AND contains(subject,'Brand') AND predicate = 'has' AND contains(object,'lacks')
ORDER BY extracted_at DESC, claim_id LIMIT 20"""))
def c02(spark, d):
    q = C.ClaimQuery(days=900, subject="Brand", predicate="has", object="lacks", reference=NOW)
    kept = C.filter_claims(B.claims(spark, d), None, q)
    return kept.select("claim_id", "subject", "predicate", "object", "confidence", "extracted_at").orderBy(
        F.desc("extracted_at"), "claim_id"
    ).limit(20)


_STANCE_COUNT = "SELECT 'FILTER' AS stance_filter, count(*) AS count FROM claim c WHERE {}"
_RATED = "(SELECT claim_id FROM stance WHERE user_stance IS NOT NULL)"


@query("c03_stance_filters", with_tables("claim stance", " UNION ALL ".join(
    _STANCE_COUNT.replace("FILTER", name).format(cond) for name, cond in [
        ("all", "true"),
        ("rated", f"claim_id IN {_RATED}"),
        ("unrated", f"claim_id NOT IN {_RATED}"),
        ("agrees", "claim_id IN (SELECT claim_id FROM stance WHERE user_stance = 'agrees')"),
        ("uncertain", "claim_id IN (SELECT claim_id FROM stance WHERE user_stance = 'uncertain')"),
    ])))
def c03(spark, d):
    claims, stances = B.claims(spark, d), B.stances(spark, d)
    result = None
    for name in ("all", "rated", "unrated", "agrees", "uncertain"):
        part = C.count_claims(claims, stances, C.ClaimQuery(stance=name)).select(F.lit(name).alias("stance_filter"), "count")
        result = part if result is None else result.unionByName(part)
    return result


@query("c04_valid_claims", with_tables("claim", """
SELECT post_id, count(*) FILTER (confidence >= 0.5) AS valid_count, count(*) FILTER (confidence < 0.5) AS invalid_count FROM claim GROUP BY 1"""))
def c04(spark, d):
    ok = C.is_valid_claim()
    return B.claims(spark, d).groupBy("post_id").agg(
        F.count_if(ok).alias("valid_count"), F.count_if(~ok).alias("invalid_count")
    )


@query("c05_quarantine", with_tables("claim", """
SELECT claim_id, array_to_string(list_filter([CASE WHEN c < 0.5 THEN 'confidence out of range' END,
   CASE WHEN stance = 'uncertain?' THEN 'source_stance unknown' END], lambda r: r IS NOT NULL), '; ') AS reasons
FROM (SELECT claim_id, confidence AS c, CASE WHEN predicate = 'claims' THEN source_stance || '?' ELSE source_stance END AS stance FROM claim)
WHERE c < 0.5 OR stance LIKE '%?'""".replace("stance = 'uncertain?'", "stance LIKE '%?'")))
def c05(spark, d):
    odd = B.claims(spark, d).withColumn(
        "source_stance",
        F.when(F.col("predicate") == "claims", F.concat("source_stance", F.lit("?"))).otherwise(F.col("source_stance")),
    )
    _, quarantine = V.validate(odd, V.claim_rules())
    return quarantine.select("claim_id", F.array_join("reasons", "; ").alias("reasons"))


@query("c13_search_input_rules", """
SELECT conv_id, turn, list_filter([CASE WHEN length(trim(text)) < 2 THEN 'query too short' END, CASE WHEN length(text) > 500 THEN 'query too long' END,
  CASE WHEN turn*20 NOT BETWEEN 1 AND 100 THEN 'max_results out of range' END, CASE WHEN conv_id NOT BETWEEN 1 AND 365 THEN 'days out of range' END,
  CASE WHEN length(role) > 100 THEN 'predicate too long' END], lambda r: r IS NOT NULL)::VARCHAR[] AS reasons FROM conversations""")
def c13(spark, d):
    turns = B.conversations(spark, d)
    asked = turns.select(
        "conv_id", "turn", F.col("text").alias("query"), (F.col("turn") * 20).alias("max_results"),
        F.col("conv_id").alias("days"), F.col("role").alias("predicate"),
    )
    return V.with_reasons(asked, V.search_rules()).select("conv_id", "turn", "reasons")


# -- joins ----------------------------------------------------------------------------------------------


@query("d01_claims_with_stance", with_tables("claim stance", """
SELECT c.claim_id, c.subject, s.user_stance FROM claim c LEFT JOIN stance s USING (claim_id)"""))
def d01(spark, d):
    return C.with_user_stance(B.claims(spark, d), B.stances(spark, d)).select("claim_id", "subject", "user_stance")


_SEED_SQL = "(VALUES " + ",".join(
    f"('{n}','{t}')" for n, t in vocab.SEED_PREDICATES) + ") AS seed(name, description)"


@query("d02_claim_details", with_tables("claim stance", f"""
SELECT c.claim_id, subject, predicate, object, confidence, extracted_at, description AS predicate_description,
  name IS NOT NULL AS predicate_is_builtin, coalesce(content_author_stance,'not-stated') AS content_author_stance,
  coalesce(commenter_agree_pct, 0) AS commenter_agree_pct, coalesce(commenter_disagree_pct, 0) AS commenter_disagree_pct, user_stance, user_note
FROM claim c LEFT JOIN {_SEED_SQL} ON name = predicate LEFT JOIN stance s USING (claim_id)"""))
def d02(spark, d):
    return C.claim_details(B.claims(spark, d), C.seed_predicates(spark), B.stances(spark, d))


@query("d03_my_stances", with_tables("claim stance", """
SELECT claim_id, user_stance, user_note, subject, predicate, object FROM stance JOIN claim USING (claim_id) WHERE user_stance IS NOT NULL"""))
def d03(spark, d):
    return C.my_stances(B.claims(spark, d), B.stances(spark, d))


@query("d04_unrated_claims", with_tables("claim stance", f"""
SELECT claim_id, subject, predicate, object FROM claim WHERE claim_id NOT IN {_RATED}"""))
def d04(spark, d):
    kept = C.filter_claims(B.claims(spark, d), B.stances(spark, d), C.ClaimQuery(stance="unrated"))
    return kept.select("claim_id", "subject", "predicate", "object")


# -- counts and statistics --------------------------------------------------------------------------------


@query("e01_claim_count", with_tables("claim", """
SELECT count(*) AS count FROM claim WHERE extracted_at >= TIMESTAMP '2001-11-04' - INTERVAL 365 DAY AND predicate = 'opposes'"""))
def e01(spark, d):
    return C.count_claims(B.claims(spark, d), None, C.ClaimQuery(days=365, predicate="opposes", reference=NOW))


@query("e02_top_predicates", with_tables("claim", """
SELECT predicate, count(*) AS count FROM claim GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def e02(spark, d):
    return C.top_values(B.claims(spark, d), "predicate", 20)


@query("e03_subreddit_themes", with_tables("claim post", """
kept AS (SELECT * FROM claim WHERE post_id IN (SELECT post_id FROM post WHERE subreddit = 'src3') AND extracted_at >= TIMESTAMP '2001-11-04' - INTERVAL 1500 DAY)
SELECT * FROM (SELECT 'predicate' AS kind, predicate AS name, count(*) AS count FROM kept GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'subject' AS kind, subject AS name, count(*) AS count FROM kept GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""))
def e03(spark, d):
    kept = C.claims_of_subreddit(B.claims(spark, d), B.posts(spark, d), "src3")
    parts = [
        C.top_values(kept, kind, 10, C.cutoff(NOW, 1500)).select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), "count")
        for kind in ("predicate", "subject")
    ]
    return parts[0].unionByName(parts[1])


@query("e04_embedding_stats", with_tables("claim", """
SELECT count(*) AS total, count(*) FILTER (has_embedding) AS with_embedding, count(*) FILTER (is_canonical) AS canonical,
  count(*) FILTER (NOT is_canonical) AS duplicates FROM claim"""))
def e04(spark, d):
    return C.embedding_stats(B.claims(spark, d))


@query("e08_predicate_registry", with_tables("claim", f"""
SELECT coalesce(name, predicate) AS name, description, name IS NOT NULL AS is_builtin,
  CASE WHEN name IS NULL THEN seen END AS first_seen, coalesce(n, 0) AS usage_count
FROM {_SEED_SQL} FULL JOIN (SELECT predicate, count(*) AS n, min(extracted_at) AS seen FROM claim GROUP BY 1) u ON name = predicate"""))
def e08(spark, d):
    return C.count_predicate_use(C.seed_predicates(spark), B.claims(spark, d))


@query("e08_new_predicates", with_tables("claim", f"""
SELECT predicate AS name, min(extracted_at) AS first_seen, count(*) AS usage_count FROM claim
WHERE predicate NOT IN (SELECT name FROM {_SEED_SQL}) GROUP BY 1"""))
def e08_new(spark, d):
    registry = C.count_predicate_use(C.seed_predicates(spark), B.claims(spark, d))
    return C.new_predicates(registry).select("name", "first_seen", "usage_count")


@query("e08_predicate_ranks", with_tables("claim", f"""
SELECT coalesce(name, predicate) AS name, coalesce(n, 0) AS usage_count, row_number() OVER (ORDER BY coalesce(n, 0) DESC, coalesce(name, predicate)) AS place
FROM {_SEED_SQL} FULL JOIN (SELECT predicate, count(*) AS n FROM claim GROUP BY 1) u ON name = predicate"""))
def e08_ranks(spark, d):
    ordered = C.predicates_by_use(C.count_predicate_use(C.seed_predicates(spark), B.claims(spark, d)))
    # One row per predicate name: a handful of rows, numbered in their order.
    place = F.row_number().over(Window.orderBy(F.desc("usage_count"), "name"))
    return ordered.select("name", "usage_count", place.alias("place"))


@query("g11_triple_upsert", with_tables("claim", """
SELECT subject, predicate, object, max(confidence) AS confidence, min(extracted_at) AS extracted_at, min(claim_id) AS claim_id FROM claim GROUP BY 1,2,3"""))
def g11(spark, d):
    return C.upsert_triples(B.claims(spark, d))


# -- table maintenance ----------------------------------------------------------------------------------------


@query("l01_comment_upsert", with_tables("comment", """
SELECT comment_id, post_id, parent_id, author, body, CASE WHEN event_id % 2 = 0 THEN score + 5 ELSE score END AS score, created_at FROM comment"""))
def l01(spark, d):
    """Odd comments are known; the feed brings the even ones new and every third one updated."""
    feed = B.comments(spark, d)
    number = F.substring("comment_id", 2, 20).cast("bigint")
    existing = feed.withColumn("score", F.when(number % 2 == 1, F.lit(-999)).otherwise(F.col("score")))
    incoming = feed.withColumn("score", F.when(number % 2 == 0, F.col("score") + 5).otherwise(F.col("score")))
    return U.upsert_comments(existing.where(number % 2 == 1), incoming)


@query("l01_post_upsert", with_tables("post", """
SELECT post_id, title, author, CASE WHEN post_no % 3 = 0 THEN score + 7 ELSE score END AS score, num_comments,
  CASE WHEN post_no % 3 = 0 THEN created_at + INTERVAL 2 HOUR ELSE created_at END AS fetched_at FROM post"""))
def l01_posts(spark, d):
    """Two of three posts are known, every third arrives twice, the later fetch with a new score."""
    posts = B.posts(spark, d).withColumn("fetched_at", F.col("created_at"))
    columns = ["post_id", "title", "author", "score", "num_comments", "fetched_at"]
    third = F.col("post_no") % 3 == 0
    later = posts.where(third).withColumn("score", F.col("score") + 7).withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 2 HOURS"))
    feed = posts.where(third).select(*columns).unionByName(later.select(*columns))
    return U.upsert_posts(posts.where(F.col("post_no") % 3 != 1).select(*columns), feed.unionByName(posts.where(F.col("post_no") % 3 == 1).select(*columns)))


@query("l02_author_stance_upsert", with_tables("claim stance", """
SELECT claim_id, coalesce(source_stance, content_author_stance) AS content_author_stance, coalesce(commenter_agree_pct, 0) AS commenter_agree_pct,
  coalesce(commenter_disagree_pct, 0) AS commenter_disagree_pct, user_stance, user_note
FROM claim FULL JOIN stance USING (claim_id)"""))
def l02(spark, d):
    return U.upsert_author_stances(B.stances(spark, d), B.claims(spark, d))


@query("l03_stance_events", with_tables("claim stance", """
ev AS (SELECT event_id, ts, (['Brand#1','Brand#2','Go','Rust'])[1 + event_id % 4] AS s, (['supports','uses','has'])[1 + event_id % 3] AS p,
   'Brand#' || (event_id % 25) AS o, (['agrees','disagrees','neutral','uncertain', NULL])[1 + user_id % 5] AS st FROM events),
last AS (SELECT s, p, o, arg_max(struct_pack(st := st), (ts, coalesce(st, ''))) AS e FROM ev GROUP BY 1,2,3),
known AS (SELECT subject, predicate, object, min(claim_id) AS claim_id FROM claim GROUP BY 1,2,3),
feed AS (SELECT coalesce(claim_id, 'claim:' || substr(sha256(to_json([s, p, o])::VARCHAR), 1, 20)) AS claim_id, e.st AS st, true AS touched
  FROM last LEFT JOIN known k ON k.subject = s AND k.predicate = p AND k.object = o WHERE k.claim_id IS NOT NULL OR e.st IS NOT NULL)
SELECT claim_id, coalesce(content_author_stance, 'not-stated') AS content_author_stance, coalesce(commenter_agree_pct, 0) AS commenter_agree_pct,
  CASE WHEN touched THEN st ELSE user_stance END AS user_stance, CASE WHEN touched THEN NULL ELSE user_note END AS user_note
FROM (SELECT *, true AS old FROM stance) FULL JOIN feed USING (claim_id) WHERE old OR st IS NOT NULL"""))
def l03(spark, d):
    """Events that add claims, change stored stances and withdraw them, against the whole stance table."""
    e, u = F.col("event_id"), F.col("user_id")
    pick = B._pick
    words = F.concat_ws(
        " ", pick(["Brand#1", "Brand#2", "Go", "Rust"], e % 4), pick(["supports", "uses", "has"], e % 3),
        F.concat(F.lit("Brand#"), (e % 25).cast("string")),
    )
    events = B.read_table(spark, d, "events").select(
        F.col("ts").alias("event_at"), words.alias("claim_text"),
        pick(["Agree", "disagree", "neutral", "uncertain", "remove"], u % 5).alias("stance"), F.lit(None).cast("string").alias("note"),
    )
    _, updated = U.apply_stance_events(B.claims(spark, d), B.stances(spark, d), events)
    return updated.select("claim_id", "content_author_stance", "commenter_agree_pct", "user_stance", "user_note")


@query("l04_digest_records", with_tables("summary claim", """
SELECT digest_date, 'post' AS kind, post_id AS member_id FROM summary
UNION SELECT digest_date, 'claim' AS kind, claim_id AS member_id FROM summary JOIN claim USING (post_id) WHERE claim.confidence >= 0.5"""))
def l04(spark, d):
    posts = B.summaries(spark, d).select("digest_date", "post_id")
    claims = B.claims(spark, d).where(C.is_valid_claim()).select("claim_id", "post_id")
    members = posts.select("digest_date", F.lit("post").alias("kind"), F.col("post_id").alias("member_id")).unionByName(
        posts.join(claims, "post_id").select("digest_date", F.lit("claim").alias("kind"), F.col("claim_id").alias("member_id"))
    )
    return U.digest_records(members)


# -- predicate relations ----------------------------------------------------------------------------------------


def _opposite_values() -> str:
    rows = [f"('{a}','{b}')" for a, others in vocab.PREDICATE_OPPOSITES.items() for b in others]
    return "(VALUES " + ",".join(rows) + ") AS opp(a, b)"


@query("i01_opposite_predicates", with_tables("claim", f"""
p AS (SELECT DISTINCT predicate FROM claim),
sym AS (SELECT a, b FROM {_opposite_values()} UNION SELECT b, a FROM {_opposite_values()})
SELECT predicate, b AS opposite, predicate IN ({",".join("'" + c + "'" for c in vocab.COMPARATIVE_PREDICATES)}) AS comparative
FROM p LEFT JOIN sym ON a = predicate"""))
def i01(spark, d):
    names = B.claims(spark, d).select("predicate").distinct()
    return names.select(
        "predicate", P.is_comparative(F.col("predicate")).alias("comparative"),
        F.explode_outer(P.opposites_of(F.col("predicate"))).alias("opposite"),
    )


@query("i03_negation_classes", with_tables("claim", """
o AS (SELECT claim_id, object, regexp_replace(lower(object), '[^a-z0-9\\s-]', '', 'g') AS n FROM claim)
SELECT claim_id, object, regexp_matches(n, '^has[-\\s]') AS is_positive, regexp_matches(n, '^lacks[-\\s]|^missing[-\\s]') AS is_negative FROM o"""))
def i03(spark, d):
    return B.claims(spark, d).select(
        "claim_id", "object",
        (F.size(P.negation_classes(F.col("object"), True)) > 0).alias("is_positive"),
        (F.size(P.negation_classes(F.col("object"), False)) > 0).alias("is_negative"),
    )
