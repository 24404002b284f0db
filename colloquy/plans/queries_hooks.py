"""Registered queries: search by text, labeler and verifier hooks, merges into tables by bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import colloquy.plans.queries_claims  # noqa: F401 - its SQL is used again
from colloquy.operators import clustering as H
from colloquy.operators import contradictions as I
from colloquy.operators import text_search as TS
from colloquy.operators import upsert as U
from colloquy.operators.bucket_table import BucketTable
from colloquy.plans import bindings as B
from colloquy.plans.oracle import with_tables
from colloquy.plans.queries_semantic import LABEL_SQL, RELATED, VERDICT_SQL, by_label
from colloquy.plans.registry import ORACLES, query
from colloquy.session import ensure_checkpoint_dir


def _table(spark, key, buckets=16):
    """A new table by buckets beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return BucketTable(f"{spark.sparkContext.getCheckpointDir()}/buckets-{uuid.uuid4().hex}", key, buckets)


# -- search by text -----------------------------------------------------------------------------------------


@query("n01_text_search", with_tables("claim", """
c AS (SELECT claim_id, lower(subject || ' ' || replace(predicate, '-', ' ') || ' ' || object) AS t FROM claim WHERE is_canonical),
q AS (SELECT s_suppkey AS query_id, lower('which brand#' || (1 + s_suppkey % 25) || (['  supports', ' opposes the', ' HAS'])[1 + s_suppkey % 3]
  || ' brand#' || (1 + s_suppkey % 7)) AS t FROM supplier),
w AS (SELECT t, term, count(*) AS n FROM (SELECT t, unnest(string_split_regex(t, '\\s+')) AS term FROM (SELECT t FROM c UNION SELECT t FROM q)) GROUP BY 1, 2),
l AS (SELECT t, sqrt(sum(n * n)) AS len FROM w GROUP BY 1),
s AS (SELECT a.t AS qt, b.t AS ct, round(sum(a.n * b.n / (la.len * lb.len)), 12) AS sim FROM (SELECT DISTINCT t FROM q) JOIN w a USING (t)
  JOIN w b ON a.term = b.term JOIN (SELECT DISTINCT t FROM c) d ON d.t = b.t JOIN l la ON la.t = a.t JOIN l lb ON lb.t = b.t GROUP BY 1, 2),
r AS (SELECT query_id, claim_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, claim_id) AS rank
  FROM q JOIN s ON s.qt = q.t JOIN c ON c.t = s.ct WHERE sim >= 0.5)
SELECT query_id, claim_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 10"""))
def n01(spark, d):
    """Every supplier asks for two brands and a predicate in words."""
    key = F.col("s_suppkey")
    verb = F.element_at(F.array(F.lit("  supports"), F.lit(" opposes the"), F.lit(" HAS")), (1 + key % 3).cast("int"))
    text = F.concat(F.lit("which Brand#"), (1 + key % 25).cast("string"), verb, F.lit(" Brand#"), (1 + key % 7).cast("string"))
    queries = B.read_table(spark, d, "supplier").select(key.alias("query_id"), text.alias("text"))
    found = TS.search_claims_by_text(B.claims(spark, d), queries, 10, 0.5)
    return found.select("query_id", "claim_id", F.round("similarity", 6).alias("similarity"), "rank")


# -- hooks ----------------------------------------------------------------------------------------------------


def _labeler(sentences):
    """A deterministic stand-in for a model; it fails on some clusters."""
    if len(sentences[0]) % 2 == 0:
        raise ValueError("no label")
    return f"About {sentences[0]}", sentences[-1], sorted(set(sentences))[:2]


@query("n02_labelled_themes", with_tables("vec", LABEL_SQL + """,
told AS (SELECT c, list(sentence ORDER BY claim_id) AS s FROM (
  SELECT c, claim_id, subject || ' ' || replace(predicate, '-', ' ') || ' ' || object AS sentence, row_number() OVER (PARTITION BY c ORDER BY claim_id) AS n FROM k)
  WHERE n <= 20 GROUP BY 1)
SELECT theme_id, claim_count, CASE WHEN length(s[1]) % 2 = 0 THEN name ELSE 'About ' || s[1] END AS name,
  CASE WHEN length(s[1]) % 2 = 0 THEN description ELSE s[-1] END AS description,
  CASE WHEN length(s[1]) % 2 = 0 THEN keywords ELSE list_sort(list_distinct(s))[1:2] END AS keywords FROM theme JOIN told USING (c)"""))
def n02(spark, d):
    claims, clusters = B.claim_vectors(spark, d), by_label(spark, d)
    labels = H.label_clusters(claims, clusters, F.col("claim_id"), _labeler)
    themes, _, _ = H.build_themes(claims, clusters, "run1", F.col("claim_id"), 3, labels)
    return themes.select("theme_id", "claim_count", "name", "description", "keywords")


def _verifier(pairs):
    return [((len(a) + len(b)) % 2 == 0, 0.5 + (len(a) * len(b) % 6) / 10, f"{a} / {b}") for a, b in pairs]


def _silent(pairs):
    raise AssertionError("every pair has a verdict")


@query("n03_verified_contradictions", with_tables("vec", VERDICT_SQL + """,
x AS (SELECT near.*, p.subject || ' ' || replace(p.predicate, '-', ' ') || ' ' || p.object AS s1, o.subject || ' ' || replace(o.predicate, '-', ' ') || ' ' || o.object AS s2
  FROM near JOIN vec p ON p.claim_id = claim_id_1 JOIN vec o ON o.claim_id = claim_id_2 WHERE rank <= 5 AND kind IS NULL)
SELECT claim_id_1, claim_id_2, round(similarity, 6) AS similarity, 'semantic' AS contradiction_type, round(0.5 + (length(s1) * length(s2) % 6) / 10, 4) AS confidence,
  s1 || ' / ' || s2 AS explanation FROM x WHERE (length(s1) + length(s2)) % 2 = 0 AND round(0.5 + (length(s1) * length(s2) % 6) / 10, 4) >= 0.7"""))
def n03(spark, d):
    """Verdicts of a second run, in which the verifier must not be asked: all come from the store."""
    claims = B.claim_vectors(spark, d)
    is_new = F.col("claim_id") % 3 == 0
    candidates = I.verification_candidates(claims.where(is_new), claims.where(~is_new), RELATED)
    store = _table(spark, ["claim_id_1", "claim_id_2"])
    I.verify_candidates(candidates, store, _verifier)
    verdicts = I.verify_candidates(candidates, store, _silent)
    found = I.confirmed_by_verdicts(candidates, verdicts.withColumn("confidence", F.round("confidence", 4)))
    return found.withColumn("similarity", F.round("similarity", 6))


# -- merges by bucket ----------------------------------------------------------------------------------------------


@query("l01_comment_merge", ORACLES["l01_comment_upsert"])
def l01_merge(spark, d):
    """The comment upsert as two merges: known comments first, then the feed."""
    feed = B.comments(spark, d)
    number = F.substring("comment_id", 2, 20).cast("bigint")
    known = feed.where(number % 2 == 1).withColumn("score", F.lit(-999).cast(feed.schema["score"].dataType))
    table = _table(spark, ["comment_id"])
    U.merge_comments(table, known)
    U.merge_comments(table, feed.withColumn("score", F.when(number % 2 == 0, F.col("score") + 5).otherwise(F.col("score"))))
    return table.read(spark)


@query("l02_author_stance_merge", with_tables("claim", """
SELECT claim_id, coalesce(source_stance, 'neutral') AS content_author_stance, 0.0::DOUBLE AS commenter_agree_pct, 0.0::DOUBLE AS commenter_disagree_pct,
  NULL::VARCHAR AS user_stance, NULL::VARCHAR AS user_note FROM claim"""))
def l02_merge(spark, d):
    """All claims in two feeds; the second also repeats a part of the first."""
    claims = B.claims(spark, d)
    table = _table(spark, ["claim_id"])
    post = F.substring("post_id", 2, 20).cast("bigint")
    U.merge_author_stances(table, claims.where(post % 3 != 0))
    U.merge_author_stances(table, claims.where((post % 2 == 0) | (post % 3 == 0)))
    return table.read(spark)


@query("g11_triple_merge", ORACLES["g11_triple_upsert"])
def g11_merge(spark, d):
    """Claims in two feeds, folded by their triple."""
    claims = B.claims(spark, d)
    table = _table(spark, ["subject", "predicate", "object"])
    U.merge_triples(table, claims.where("confidence >= 0.7"))
    U.merge_triples(table, claims.where("confidence < 0.7"))
    return table.read(spark)
