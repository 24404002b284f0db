"""Registered queries: threads, controversy, selection, ranking, topics, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.operators import controversy as K
from colloquy.operators import selection as S
from colloquy.operators import threads as J
from colloquy.operators import topics as T
from colloquy.plans import bindings as B
from colloquy.plans.oracle import with_tables
from colloquy.plans.registry import query


def _forest(spark, d):
    return J.build_forest(B.comments(spark, d))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- threads --------------------------------------------------------------------------------------------


@query("j01_thread_forest", with_tables("tree", """
SELECT t.comment_id, t.post_id, t.root_id, t.depth, CASE WHEN t.depth > 0 THEN regexp_replace(c.parent_id, '^t[13]_', '') END AS parent
FROM tree t JOIN comment c USING (comment_id)"""))
def j01(spark, d):
    return _forest(spark, d).select("comment_id", "post_id", "root_id", "depth", "parent")


@query("j02_subtree_totals", with_tables("subtree", """
SELECT comment_id, total_score, reply_count, height FROM subtree"""))
def j02(spark, d):
    return _forest(spark, d).select("comment_id", "total_score", "reply_count", "height")


@query("j03_significant_threads", with_tables("subtree", """
SELECT post_id, comment_id, total_score, reply_count, engagement, thread_rank FROM (
  SELECT t.post_id, s.*, total_score + 10*reply_count AS engagement,
    row_number() OVER (PARTITION BY post_id ORDER BY total_score + 10*reply_count DESC, comment_id) AS thread_rank
  FROM subtree s JOIN tree t USING (comment_id) WHERE depth = 0 AND (total_score >= 20 OR reply_count >= 2))
WHERE thread_rank <= 5"""))
def j03(spark, d):
    return J.significant_threads(_forest(spark, d)).select(
        "post_id", "comment_id", "total_score", "reply_count", "engagement", "thread_rank"
    )


@query("j04_thread_stats", with_tables("subtree", """
r AS (SELECT t.post_id, s.*, c.author FROM subtree s JOIN tree t USING (comment_id) JOIN comment c USING (comment_id) WHERE t.depth = 0),
best AS (SELECT post_id, author, reply_count FROM r QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY reply_count DESC, comment_id) = 1)
SELECT r.post_id, count(*) AS total_threads, round(avg(height), 6) AS avg_depth, max(height) AS max_depth,
  (SELECT count(DISTINCT author) FROM comment c WHERE c.post_id = r.post_id) AS total_participants,
  any_value(CASE WHEN best.reply_count > 0 THEN best.author END) AS most_engaged_author,
  any_value(CASE WHEN best.reply_count > 0 THEN best.reply_count END) AS most_engaged_replies
FROM r JOIN best USING (post_id) GROUP BY r.post_id"""))
def j04(spark, d):
    return J.thread_stats(_forest(spark, d)).withColumn("avg_depth", F.round("avg_depth", 6))


@query("j05_rendered_threads", with_tables("tree", """RECURSIVE
place AS (SELECT c.*, t.depth, t.root_id, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.score DESC, c.comment_id) AS k FROM comment c JOIN tree t USING (comment_id) WHERE t.depth > 0),
kept AS (SELECT c.comment_id, c.post_id, c.comment_id AS root_id, 0 AS depth, c.author, c.score, c.body, CAST([] AS BIGINT[]) AS ranks FROM comment c JOIN tree t USING (comment_id) WHERE t.depth = 0
  UNION ALL SELECT p.comment_id, p.post_id, k.root_id, k.depth + 1, p.author, p.score, p.body, list_append(k.ranks, p.k) FROM place p JOIN kept k ON 't1_' || k.comment_id = p.parent_id
  WHERE p.k <= 3 AND k.depth < 4)
SELECT post_id, root_id, string_agg(repeat('  ', depth) || CASE WHEN depth = 0 THEN '[Parent]' ELSE '[Reply]' END || ' u/' || author || ' (' || CASE WHEN score >= 0 THEN '+' ELSE '' END || score
  || '): "' || substr(body, 1, 300) || CASE WHEN length(body) > 300 THEN '...' ELSE '' END || '"', chr(10) ORDER BY ranks) AS thread_text, count(*) AS lines FROM kept GROUP BY 1, 2"""))
def j05(spark, d):
    return J.rendered_threads(_forest(spark, d), B.comments(spark, d))


@query("j06_flattened_threads", with_tables("tree", """RECURSIVE
walk AS (SELECT c.comment_id, c.post_id, t.root_id, 0 AS depth, CAST([] AS VARCHAR[]) AS steps FROM comment c JOIN tree t USING (comment_id) WHERE t.depth = 0
  UNION ALL SELECT c.comment_id, c.post_id, w.root_id, w.depth + 1, list_append(w.steps, strftime(c.created_at, '%Y%m%d%H%M%S%f') || c.comment_id) FROM comment c JOIN walk w ON c.parent_id = 't1_' || w.comment_id)
SELECT post_id, root_id, comment_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY steps) - 1 AS position FROM walk"""))
def j06(spark, d):
    return J.flattened(_forest(spark, d))


@query("j07_thread_participants", with_tables("subtree", """
SELECT t.post_id, s.comment_id AS root_id, c.author, total_score, participants,
  CASE WHEN total_score > 50 THEN 'positive' WHEN total_score < 0 THEN 'negative' ELSE 'mixed' END AS sentiment
FROM subtree s JOIN tree t USING (comment_id) JOIN comment c USING (comment_id) WHERE t.depth = 0"""))
def j07(spark, d):
    return J.thread_participants(_forest(spark, d))


# -- controversy -----------------------------------------------------------------------------------------

_KW = ",".join(f"CASE WHEN bool_or(contains(lower(t), {_quoted(k)})) THEN {_quoted(k)} END" for k in vocab.CONTROVERSY_KEYWORDS)
_CAMPS = ",".join(f"CASE WHEN bool_or(regexp_matches(t, {_quoted(p)}, 'i')) THEN {_quoted(c)} END" for p, c in vocab.CAMP_PATTERNS)
_FLAG = " OR ".join(f"contains(lower(body), {_quoted(k)})" for k in vocab.COMMENT_FLAG_KEYWORDS)
_POS = " OR ".join(f"contains(lower(body), '{w}')" for w in vocab.POSITIVE_WORDS)
_NEG = " OR ".join(f"contains(lower(body), '{w}')" for w in vocab.NEGATIVE_WORDS)

_DETECT = f"""
texts AS (SELECT post_id, body || ' ' AS t FROM comment UNION ALL SELECT post_id, title || ' ' || content || ' ' FROM post),
words AS (SELECT post_id, list_filter([{_KW}], lambda x: x IS NOT NULL) AS keyword_hits,
  list_filter([{_CAMPS}], lambda x: x IS NOT NULL) AS camps FROM texts GROUP BY 1),
depths AS (SELECT post_id, max(depth) + 1 AS reply_depth FROM tree GROUP BY 1),
moods AS (SELECT post_id, count(*) AS comment_count, stddev_pop(score) AS score_stddev, avg(CASE WHEN score < 0 THEN 1.0::DOUBLE ELSE 0 END) AS negative_ratio,
  count(*) FILTER ({_POS}) >= 2 AND count(*) FILTER ({_NEG}) >= 2 AS sentiment_mix FROM comment GROUP BY 1),
detected AS (SELECT post_id, coalesce(score_stddev, 0) AS score_stddev, coalesce(negative_ratio, 0) AS negative_ratio, coalesce(reply_depth, 0) AS reply_depth,
  coalesce(comment_count, 0) AS comment_count, keyword_hits, camps, coalesce(sentiment_mix, false) AS sentiment_mix,
  round(least(1.0::DOUBLE, CASE WHEN score_stddev > 100 THEN 0.3 WHEN score_stddev > 50 THEN 0.15 ELSE 0 END
   + CASE WHEN negative_ratio > 0.2 THEN 0.2 WHEN negative_ratio > 0.1 THEN 0.1 ELSE 0 END
   + CASE WHEN reply_depth >= 5 THEN 0.2 WHEN reply_depth >= 3 THEN 0.1 ELSE 0 END
   + CASE WHEN len(keyword_hits) >= 5 THEN 0.2 WHEN len(keyword_hits) >= 2 THEN 0.1 ELSE 0 END
   + CASE WHEN sentiment_mix THEN 0.15 ELSE 0 END + CASE WHEN len(camps) >= 2 THEN 0.15 ELSE 0 END), 4)::DOUBLE AS controversy_score
  FROM post JOIN words USING (post_id) LEFT JOIN depths USING (post_id) LEFT JOIN moods USING (post_id))"""


def _detected(spark, d):
    forest = J.build_forest(B.comments(spark, d))
    return K.detect_controversy(B.posts(spark, d), B.comments(spark, d), forest), forest


@query("k01_controversy", with_tables("post tree", _DETECT + """
SELECT post_id, round(score_stddev, 6) AS score_stddev, round(negative_ratio, 6) AS negative_ratio, reply_depth, comment_count,
  keyword_hits, camps, sentiment_mix, controversy_score, controversy_score >= 0.4 AS is_controversial FROM detected"""))
def k01(spark, d):
    detected, _ = _detected(spark, d)
    return detected.withColumn("score_stddev", F.round("score_stddev", 6)).withColumn(
        "negative_ratio", F.round("negative_ratio", 6)
    )


@query("k01_controversy_report", with_tables("post tree", _DETECT + """
SELECT post_id, 'Controversy Score: ' || CAST(floor(controversy_score*100 + 0.5) AS BIGINT) || '%' || chr(10) || 'Is Controversial: ' || (controversy_score >= 0.4)
 || chr(10) || 'Signals:' || chr(10) || '  - Score Variance: ' || printf('%.1f', floor(score_stddev*10 + 0.5)/10) || chr(10) || '  - Negative Ratio: ' || printf('%.1f', floor(negative_ratio*1000 + 0.5)/10)
 || '%' || chr(10) || '  - Reply Depth: ' || reply_depth || chr(10) || '  - Keyword Hits: ' || len(keyword_hits) || chr(10) || '  - Sentiment Mix: ' || sentiment_mix
 || CASE WHEN len(camps) > 0 THEN chr(10) || 'Detected Camps: ' || array_to_string(camps, ', ') ELSE '' END AS report FROM detected"""))
def k01_report(spark, d):
    return K.controversy_report(_detected(spark, d)[0])


@query("k07_comment_flags", with_tables("comment", f"""
SELECT comment_id, ({_FLAG}) AS debated, ({_POS}) AS is_positive, ({_NEG}) AS is_negative FROM comment"""))
def k07(spark, d):
    from colloquy.functions import signals

    body = F.col("lowered")
    return B.comments(spark, d).withColumn("lowered", F.lower("body")).select(
        "comment_id", signals.has_controversial_words(body).alias("debated"),
        signals.is_positive(body).alias("is_positive"), signals.is_negative(body).alias("is_negative"),
    )


@query("c12_summary_routes", with_tables("post subtree", _DETECT + """,
st AS (SELECT t.post_id, max(height) AS max_depth, (SELECT count(DISTINCT author) FROM comment c WHERE c.post_id = t.post_id) AS people
  FROM subtree s JOIN tree t USING (comment_id) WHERE t.depth = 0 GROUP BY 1)
SELECT post_id, controversy_score, use_hierarchical,
  CASE WHEN controversy_score >= 0.5 THEN 'cot' WHEN use_hierarchical THEN 'hierarchical' ELSE 'standard' END AS route
FROM (SELECT *, coalesce(comment_count >= 20 AND (max_depth >= 3 OR people >= 10), false) AS use_hierarchical FROM detected LEFT JOIN st USING (post_id))"""))
def c12(spark, d):
    detected, forest = _detected(spark, d)
    return K.summary_route(detected, J.thread_stats(forest))


@query("c12_story_gate", with_tables("summary", """
SELECT post_id, NOT (score < 10 AND num_comments < 5) AND NOT (information_density = 'sparse' AND score < 100 AND num_comments < 20) AS narrate FROM summary"""))
def c12_story(spark, d):
    gate = K.should_narrate(F.col("score"), F.col("num_comments"), F.col("information_density"))
    return B.summaries(spark, d).select("post_id", gate.alias("narrate"))


@query("c12_daily_gates", with_tables("summary subtree", """
sig AS (SELECT post_id, comment_id, row_number() OVER (PARTITION BY post_id ORDER BY total_score + 10*reply_count DESC, comment_id) AS k
  FROM subtree JOIN tree USING (comment_id) WHERE depth = 0 AND (total_score >= 20 OR reply_count >= 2)),
many AS (SELECT post_id FROM sig WHERE k <= 5 GROUP BY 1 HAVING count(*) >= 2)
SELECT digest_date, count(*) AS posts, count(*) >= 3 AS synthesize_themes, count(*) >= 2 AS rank_posts, count(*) >= 2 AS synthesize_what_matters,
  count(many.post_id) AS posts_with_threads FROM summary LEFT JOIN many USING (post_id) GROUP BY 1"""))
def c12_daily(spark, d):
    return K.daily_gates(B.summaries(spark, d), J.significant_threads(_forest(spark, d)))


@query("e07_comment_diversity", with_tables("comment", f"""
SELECT post_id, count(*) AS total_comments, min(score) AS min_score, max(score) AS max_score, round(stddev_pop(score), 6) AS score_stddev,
  count(*) FILTER ({_FLAG}) AS controversial_count, round(avg(length(body)), 6) AS avg_body_length FROM comment GROUP BY 1"""))
def e07(spark, d):
    return K.comment_diversity(B.comments(spark, d)).withColumn("score_stddev", F.round("score_stddev", 6)).withColumn(
        "avg_body_length", F.round("avg_body_length", 6)
    )


# -- selection ----------------------------------------------------------------------------------------------


@query("c06_recent_posts", with_tables("post", """
SELECT post_id, created_at FROM post WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR"""))
def c06(spark, d):
    return S.recent_posts(B.posts(spark, d), F.lit("2024-01-31").cast("timestamp_ntz"), 240).select("post_id", "created_at")


@query("c07_substantive_comments", with_tables("comment", """
SELECT comment_id, post_id FROM comment WHERE length(body) >= 50 AND author <> '[deleted]'"""))
def c07(spark, d):
    return B.comments(spark, d).where(S.substantive()).select("comment_id", "post_id")


@query("c11_high_confidence_claims", with_tables("claim", """
SELECT post_id, claim_id, claim_no FROM (SELECT post_id, claim_id, row_number() OVER (PARTITION BY post_id ORDER BY extracted_at, claim_id) AS claim_no
  FROM claim WHERE confidence >= 0.8) WHERE claim_no <= 3"""))
def c11(spark, d):
    return S.top_claims_per_post(B.claims(spark, d)).select("post_id", "claim_id", "claim_no")


@query("d08_reply_counts", with_tables("comment", """
SELECT c.comment_id, coalesce(n, 0) AS replies FROM comment c
LEFT JOIN (SELECT regexp_replace(parent_id, '^t[13]_', '') AS comment_id, count(*) AS n FROM comment GROUP BY 1) r USING (comment_id)"""))
def d08(spark, d):
    return S.reply_counts(B.comments(spark, d)).select("comment_id", "replies")


@query("f02_post_selection", with_tables("post", """
SELECT post_id, subreddit, score, pick_no FROM (SELECT p.*, row_number() OVER (PARTITION BY subreddit ORDER BY feed_pos, post_id) AS pick_no
  FROM post p JOIN (SELECT subreddit, avg(score) AS a FROM post GROUP BY 1) m USING (subreddit) WHERE score >= a * 0.8) WHERE pick_no <= 5"""))
def f02(spark, d):
    return S.select_posts(B.posts(spark, d), 5, 0.8).select("post_id", "subreddit", "score", "pick_no")


@query("f03_top_comments", with_tables("comment", """
SELECT post_id, comment_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, comment_id) AS rank FROM comment) WHERE rank <= 50"""))
def f03(spark, d):
    return S.top_comments(B.comments(spark, d), 50).select("post_id", "comment_id", "score", "rank")


_UNPICKED = "list_filter({src}, lambda x: NOT list_contains({taken}, x))"


def _stage(src: str, taken: str, upto: int) -> str:
    return f"list_slice({_UNPICKED.format(src=src, taken=taken)}, 1, greatest({upto} - len({taken}), 0))"


PICKS = f"""
g AS (SELECT c.*, coalesce(n, 0) AS replies, length(body) >= 50 AND author <> '[deleted]' AS good FROM comment c
  LEFT JOIN (SELECT regexp_replace(parent_id, '^t[13]_', '') AS pid, count(*) AS n FROM comment GROUP BY 1) r ON pid = comment_id),
m AS (SELECT post_id, count(*) FILTER (good) AS n_good, avg(score) FILTER (good) AS a FROM g GROUP BY 1),
l AS (SELECT post_id, any_value(n_good) AS n_good,
  coalesce(list(comment_id ORDER BY score DESC, comment_id) FILTER (good), []) AS s,
  coalesce(list(comment_id ORDER BY replies DESC, comment_id) FILTER (good), []) AS r,
  coalesce(list(comment_id ORDER BY abs(score - a), comment_id) FILTER (good AND ({_FLAG})), []) AS c,
  coalesce(list(comment_id ORDER BY length(body) DESC, comment_id) FILTER (good AND score < a AND score > -10 AND length(body) > 100), []) AS x,
  list(comment_id ORDER BY created_at, comment_id) FILTER (good OR n_good = 0) AS f
  FROM g JOIN m USING (post_id) GROUP BY 1),
s1 AS (SELECT *, list_slice(s, 1, 4) AS p1 FROM l),
s2 AS (SELECT *, {_stage('r', 'p1', 6)} AS p2 FROM s1),
s3 AS (SELECT *, {_stage('c', '(p1 || p2)', 8)} AS p3 FROM s2),
s4 AS (SELECT *, {_stage('x', '(p1 || p2 || p3)', 10)} AS p4 FROM s3),
s5 AS (SELECT *, {_stage('s', '(p1 || p2 || p3 || p4)', 10)} AS p5 FROM s4),
z AS (SELECT post_id, CASE WHEN n_good <= 10 THEN list_transform(list_slice(f,1,10), lambda i: {{'c': i, 'k': 'all'}}) ELSE
  list_transform(p1, lambda i: {{'c': i, 'k': 'top'}}) || list_transform(p2, lambda i: {{'c': i, 'k': 'replied'}}) ||
  list_transform(p3, lambda i: {{'c': i, 'k': 'controversial'}}) || list_transform(p4, lambda i: {{'c': i, 'k': 'contrarian'}}) ||
  list_transform(p5, lambda i: {{'c': i, 'k': 'fill'}}) END AS picks FROM s5),
picked AS (SELECT post_id, pick_no, picks[pick_no].c AS comment_id, picks[pick_no].k AS category
  FROM (SELECT post_id, picks, unnest(range(1, len(picks) + 1)) AS pick_no FROM z))"""


@query("f04_diverse_comments", with_tables("comment", PICKS + " SELECT * FROM picked"))
def f04(spark, d):
    return S.diverse_comments(B.comments(spark, d), 10)


# -- importance ----------------------------------------------------------------------------------------------

_SCORED = """
scored AS (SELECT *, CAST(least(100, greatest(0, floor(1.5*(least(30.0::DOUBLE, 5*log10(greatest(1, score)) + 5*log10(greatest(1, num_comments)))
  + CASE controversy_level WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END
  + CASE information_density WHEN 'rich' THEN 10 WHEN 'moderate' THEN 5 ELSE 0 END
  + CASE sentiment WHEN 'negative' THEN 10 WHEN 'mixed' THEN 5 ELSE 0 END) + 0.5))) AS BIGINT) AS importance_score FROM summary)"""
_RANKED = _SCORED + """,
cuts AS (SELECT digest_date, list_extract(list(importance_score ORDER BY importance_score), CAST(greatest(1, floor(count(*) * 0.2)) AS INT)) AS low_activity_threshold
  FROM scored GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY importance_score DESC, post_id) AS importance_rank,
  importance_score <= low_activity_threshold AS is_low_activity FROM scored JOIN cuts USING (digest_date))"""


@query("f05_importance", with_tables("summary", _SCORED + " SELECT post_id, importance_score FROM scored"))
def f05(spark, d):
    return S.score_posts(B.summaries(spark, d)).select("post_id", "importance_score")


@query("f06_ranked_posts", with_tables("summary", _RANKED + """
SELECT digest_date, post_id, importance_score, importance_rank, low_activity_threshold, is_low_activity FROM ranked"""))
def f06(spark, d):
    ranked = S.rank_posts(S.score_posts(B.summaries(spark, d)))
    return ranked.select(
        "digest_date", "post_id", "importance_score", "importance_rank", "low_activity_threshold", "is_low_activity"
    )


@query("f08_external_scores", with_tables("summary", _SCORED + """
SELECT post_id, CASE WHEN post_no % 3 = 0 THEN post_no % 101 ELSE importance_score END AS importance_score FROM scored"""))
def f08(spark, d):
    summaries = B.summaries(spark, d)
    n = F.col("post_no")
    given = summaries.where(n % 3 == 0).select("post_id", (n % 101).alias("importance_score"))
    return S.score_posts(summaries, given).select("post_id", "importance_score")


@query("f09_rankings_applied", with_tables("summary", _RANKED + """
SELECT post_id, CASE WHEN post_no % 4 = 0 THEN 50 ELSE importance_score END AS importance_score,
  CASE WHEN post_no % 4 = 0 THEN count(*) OVER (PARTITION BY digest_date) ELSE importance_rank END AS importance_rank,
  CASE WHEN post_no % 4 = 0 THEN false ELSE is_low_activity END AS is_low_activity FROM ranked"""))
def f09(spark, d):
    """Every fourth post comes without a ranking, so the defaults show."""
    summaries = B.summaries(spark, d)
    rankings = S.rank_posts(S.score_posts(summaries)).where(F.col("post_no") % 4 != 0)
    applied = S.apply_rankings(summaries, rankings)
    return applied.select("post_id", "importance_score", "importance_rank", "is_low_activity")


@query("f10_what_matters", with_tables("summary", _RANKED + """,
busy AS (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY importance_rank, post_id) AS place FROM ranked WHERE NOT is_low_activity),
s AS (SELECT *, regexp_replace(CASE WHEN regexp_extract(summary,'^[^.!?]+[.!?]') <> '' THEN regexp_extract(summary,'^[^.!?]+[.!?]')
   ELSE string_split_regex(summary,'[.!?]')[1] END, '^\\s+|\\s+$', '', 'g') AS f FROM busy WHERE place <= 6)
SELECT digest_date, place, post_id, CASE WHEN importance_score >= 70 OR controversy_level = 'high' OR sentiment = 'negative' THEN 'urgent'
  WHEN importance_score >= 45 OR controversy_level = 'medium' OR sentiment = 'mixed' THEN 'developing' ELSE 'informational' END AS priority,
  CASE WHEN length(f) <= 80 THEN f ELSE substr(f,1,77) || '...' END AS impact FROM s"""))
def f10(spark, d):
    ranked = S.rank_posts(S.score_posts(B.summaries(spark, d)))
    return S.what_matters(ranked).select("digest_date", "place", "post_id", "priority", "impact")


@query("b11_priority", with_tables("summary", _SCORED + """
SELECT post_id, CASE WHEN importance_score >= 70 OR controversy_level = 'high' OR sentiment = 'negative' THEN 'urgent'
  WHEN importance_score >= 45 OR controversy_level = 'medium' OR sentiment = 'mixed' THEN 'developing' ELSE 'informational' END AS priority FROM scored"""))
def b11(spark, d):
    from colloquy.functions.text import priority

    scored = S.score_posts(B.summaries(spark, d))
    return scored.select("post_id", priority("importance_score", "controversy_level", "sentiment").alias("priority"))


# -- topics, counts, budgets -------------------------------------------------------------------------------------

_TOPICS = """
topics AS (SELECT digest_date, post_id, sentiment, controversy_level, trim(lower(unnest(key_topics))) AS topic FROM summary),
clusters AS (SELECT digest_date, topic, count(*) AS mentions, count(DISTINCT post_id) AS posts, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (controversy_level IN ('medium','high')) AS controversial
  FROM topics GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("e10_digest_counts", with_tables("summary claim", """
SELECT digest_date, count(*) AS post_count, count(DISTINCT subreddit) AS subreddit_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS claim_count
FROM summary LEFT JOIN (SELECT post_id, count(*) AS n FROM claim GROUP BY 1) USING (post_id) GROUP BY 1"""))
def e10(spark, d):
    return T.digest_counts(B.summaries(spark, d), B.claims(spark, d))


@query("e12_topic_clusters", with_tables("summary", _TOPICS + " SELECT * FROM clusters"))
def e12(spark, d):
    return T.topic_clusters(B.summaries(spark, d))


@query("e13_topic_conflicts", with_tables("summary", _TOPICS + """
SELECT *, positive > 0 AND negative > 0 AS opposed FROM clusters WHERE (positive > 0 AND negative > 0) OR controversial > 0"""))
def e13(spark, d):
    return T.topic_conflicts(B.summaries(spark, d))


@query("e09_usage_totals", with_tables("usage", """
SELECT run_date, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS requests,
  round(sum(input_tokens)/1e6*3.0 + sum(output_tokens)/1e6*15.0, 6) AS cost_usd FROM usage GROUP BY 1"""))
def e09(spark, d):
    return T.usage_totals(B.llm_usage(spark, d)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("n04_daily_budget", with_tables("usage", """
p AS (SELECT *, coalesce(sum(input_tokens*3 + output_tokens*15) OVER (PARTITION BY run_date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM usage),
stop AS (SELECT run_date, min(seq) AS stop FROM p WHERE 25000000 - spent < input_tokens*3 + output_tokens*15 GROUP BY 1)
SELECT run_date, seq, input_tokens, output_tokens, round(spent/1e6, 6) AS spent_before, stop IS NULL OR seq < stop AS allowed FROM p LEFT JOIN stop USING (run_date)"""))
def n04(spark, d):
    return T.budget_decisions(B.llm_usage(spark, d), 25.0).withColumn("spent_before", F.round("spent_before", 6))
