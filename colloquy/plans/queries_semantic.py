"""Registered queries: vectors, search, related claims, deduplication, contradictions, themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import vectors as V
from colloquy.operators import claims as C
from colloquy.operators import clustering as H
from colloquy.operators import contradictions as I
from colloquy.operators import dedup as D
from colloquy.operators import related as G
from colloquy.operators.similarity import duplicate_pairs, unit_vectors
from colloquy.plans import bindings as B
from colloquy.plans.oracle import with_tables
from colloquy.plans.registry import query
from colloquy.session import materialize

# The fixture vectors are nearly orthogonal, so thresholds are lower than the defaults.
DUPLICATE, RELATED, SEARCH, CONTRADICT = 0.40, 0.30, 0.20, 0.10
LINKAGE, EPSILON = 0.35, 0.65

_CANON = "canon AS (SELECT * FROM vec WHERE is_canonical)"
_SIM = "list_cosine_similarity(a.v, b.v)"


def _queries(claims):
    """Every claim vector asks once."""
    return claims.select(F.col("claim_id").alias("query_id"), "embedding")


def _all_embedded(spark, d):
    return B.claim_vectors(spark, d)


# -- vector functions ---------------------------------------------------------------------------------------


@query("a01_canonical_embedded", with_tables("claim", """
SELECT claim_id, subject, predicate, object FROM claim WHERE has_embedding AND is_canonical"""))
def a01(spark, d):
    return C.canonical_embedded(B.claims(spark, d)).select("claim_id", "subject", "predicate", "object")


@query("b15_vector_norms", with_tables("vec", """
SELECT claim_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1]/sqrt(list_dot_product(v, v)), 6) AS first_unit, len(v) AS dimension FROM vec"""))
def b15(spark, d):
    e = F.col("embedding")
    return B.claim_vectors(spark, d).select(
        "claim_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.normalize(e)[0], 6).alias("first_unit"), F.size(e).alias("dimension")
    )


@query("b16_vector_pairs", with_tables("vec", """
SELECT a.claim_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS distance
FROM vec a JOIN vec b ON b.claim_id = a.claim_id + 1"""))
def b16(spark, d):
    left = B.claim_vectors(spark, d).select("claim_id", "embedding")
    right = left.select((F.col("claim_id") - 1).alias("claim_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return left.join(right, "claim_id").select(
        "claim_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.euclidean(a, b), 6).alias("distance")
    )


# -- search and related claims ---------------------------------------------------------------------------------


@query("g01_nearest_claims", with_tables("vec", f"""{_CANON}
SELECT query_id, claim_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT a.claim_id AS query_id, b.claim_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY a.claim_id ORDER BY {_SIM} DESC, b.claim_id) AS rank
  FROM vec a JOIN canon b ON a.claim_id <> b.claim_id AND {_SIM} >= {SEARCH}) WHERE rank <= 10"""))
def g01(spark, d):
    claims = B.claim_vectors(spark, d)
    asked = _queries(claims).withColumn("exclude_ids", F.array("query_id"))
    found = G.find_similar(claims, asked, 10, SEARCH)
    return found.select("query_id", "claim_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("g02_similar_pairs", with_tables("vec", f"""{_CANON}
SELECT a.claim_id AS id_a, b.claim_id AS id_b, round({_SIM}, 6) AS similarity, 'similar' AS kind
FROM canon a JOIN canon b ON a.claim_id < b.claim_id AND {_SIM} >= {DUPLICATE}"""))
def g02(spark, d):
    rows = unit_vectors(C.canonical_embedded(B.claim_vectors(spark, d)).withColumn("id", F.col("claim_id")))
    return duplicate_pairs(rows, DUPLICATE, folded=False).withColumn("similarity", F.round("similarity", 6))


@query("g02_pairs_with_copies", with_tables("cvec", f"""
rep AS (SELECT v, min(claim_id) AS claim_id FROM cvec WHERE nz GROUP BY 1)
SELECT a.claim_id AS id_a, b.claim_id AS id_b, round({_SIM}, 6) AS similarity, 'similar' AS kind
FROM rep a JOIN rep b ON a.claim_id < b.claim_id AND {_SIM} >= {DUPLICATE}
UNION ALL SELECT rep.claim_id, c.claim_id, 1.0, 'copy' FROM rep JOIN cvec c ON c.v = rep.v AND c.claim_id > rep.claim_id"""))
def g02_copies(spark, d):
    rows = unit_vectors(B.copied_vectors(spark, d).withColumn("id", F.col("claim_id")))
    return duplicate_pairs(rows, DUPLICATE).withColumn("similarity", F.round("similarity", 6))


@query("g03_filtered_search", with_tables("vec", f"""{_CANON}
SELECT query_id, claim_id, subject, predicate, object, round(similarity, 6) AS similarity, rank FROM (
  SELECT a.claim_id AS query_id, b.*, {_SIM} AS similarity, row_number() OVER (PARTITION BY a.claim_id ORDER BY {_SIM} DESC, b.claim_id) AS rank
  FROM vec a JOIN canon b ON {_SIM} >= {SEARCH} WHERE b.predicate = 'supports') WHERE rank <= 20"""))
def g03(spark, d):
    claims = B.claim_vectors(spark, d)
    found = G.search(claims, _queries(claims), C.ClaimQuery(predicate="supports"), 20, SEARCH)
    return found.select("query_id", "claim_id", "subject", "predicate", "object", F.round("similarity", 6).alias("similarity"), "rank")


_RELATED = f"""{_CANON},
hits AS (SELECT a.claim_id, b.claim_id AS related_id, {_SIM} AS similarity,
  row_number() OVER (PARTITION BY a.claim_id ORDER BY {_SIM} DESC, b.claim_id) AS rank,
  CASE WHEN a.subject = b.subject THEN 'same-subject' WHEN a.predicate = b.predicate THEN 'same-predicate'
       WHEN a.object = b.object THEN 'same-object' ELSE 'similar' END AS relationship
  FROM vec a JOIN canon b ON a.claim_id <> b.claim_id AND {_SIM} >= {RELATED}
  WHERE coalesce(b.canonical_claim, -1) <> a.claim_id AND NOT (b.claim_id % 10 = 1 AND a.claim_id = b.claim_id - 1))"""


def _duplicate_edges(claims):
    return claims.where(F.col("claim_id") % 10 == 1).select(
        F.col("claim_id").alias("src_id"), (F.col("claim_id") - 1).alias("dst_id")
    )


@query("g04_related_claims", with_tables("vec", _RELATED + """
SELECT claim_id, related_id, round(similarity, 6) AS similarity, rank, relationship FROM hits WHERE rank <= 10"""))
def g04(spark, d):
    claims = B.claim_vectors(spark, d)
    found = G.find_related(claims, claims, 10, RELATED, _duplicate_edges(claims))
    return found.select("claim_id", "related_id", F.round("similarity", 6).alias("similarity"), "rank", "relationship")


@query("g06_related_grouped", with_tables("vec", _RELATED + """
SELECT claim_id, related_id, relationship, group_rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, relationship ORDER BY rank) AS group_rank
  FROM hits WHERE rank <= 20) WHERE group_rank <= 3"""))
def g06(spark, d):
    claims = B.claim_vectors(spark, d)
    found = G.find_related_grouped(claims, claims, 10, min_similarity=RELATED, duplicate_edges=_duplicate_edges(claims))
    return found.select("claim_id", "related_id", "relationship", "group_rank")


_BRANCH = """(SELECT x.claim_id, t.claim_id AS related_id, CAST({sim} AS DOUBLE) AS similarity, '{rel}' AS relationship, {no} AS branch FROM u x,
  LATERAL (SELECT claim_id FROM u WHERE u.{col} = x.{col} AND u.claim_id <> x.claim_id AND is_canonical ORDER BY claim_id LIMIT 10) t)"""


@query("g05_structurally_related", with_tables("vec", "u AS (SELECT * FROM vec), e AS (" + " UNION ALL ".join(
    _BRANCH.format(sim=s, rel=r, no=n, col=c)
    for n, (c, s, r) in enumerate([("subject", 0.7, "same-subject"), ("predicate", 0.5, "same-predicate"), ("object", 0.5, "same-object")])
) + """), o AS (SELECT *, row_number() OVER (PARTITION BY claim_id, related_id ORDER BY branch) AS once FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY branch, related_id) AS rank FROM o WHERE once = 1)
SELECT claim_id, rank, related_id, similarity, relationship FROM p WHERE rank <= 10"""))
def g05(spark, d):
    claims = B.claim_vectors(spark, d)
    return G.find_structurally_related(claims, claims, 10)


@query("g08_related_for_new", with_tables("vec", f"""{_CANON},
old AS (SELECT * FROM canon WHERE claim_id % 3 <> 0)
SELECT claim_id, related_id, round(similarity, 6) AS similarity, rank, related_date FROM (
  SELECT a.claim_id, b.claim_id AS related_id, {_SIM} AS similarity, CAST(b.extracted_at AS DATE) AS related_date,
    row_number() OVER (PARTITION BY a.claim_id ORDER BY {_SIM} DESC, b.claim_id) AS rank
  FROM vec a JOIN old b ON {_SIM} >= {RELATED} AND NOT (a.subject = b.subject AND a.predicate = b.predicate AND a.object = b.object)
  WHERE a.claim_id % 3 = 0) WHERE rank <= 2"""))
def g08(spark, d):
    """Claims 0, 3, 6, ... arrive as new; the others are known."""
    claims = B.claim_vectors(spark, d)
    is_new = F.col("claim_id") % 3 == 0
    found = G.related_for_new_claims(claims.where(is_new), claims.where(~is_new), 2, RELATED)
    return found.select("claim_id", "related_id", F.round("similarity", 6).alias("similarity"), "rank", "related_date")


@query("g09_suggestions", with_tables("vec", f"""{_CANON}
SELECT query_id, subject, min(rank) AS rank, round(max(similarity), 6) AS similarity FROM (
  SELECT a.claim_id AS query_id, b.subject, {_SIM} AS similarity, row_number() OVER (PARTITION BY a.claim_id ORDER BY {_SIM} DESC, b.claim_id) AS rank
  FROM vec a JOIN canon b ON {_SIM} >= 0.4) WHERE rank <= 5 GROUP BY 1, 2"""))
def g09(spark, d):
    claims = B.claim_vectors(spark, d)
    return G.suggestions(claims, _queries(claims), 5).withColumn("similarity", F.round("similarity", 6))


# -- deduplication -----------------------------------------------------------------------------------------------


#: One-by-one processing of the odd claims against the even ones, as a recursion over their order.
DEDUP_SQL = f"""
pre AS (SELECT a.claim_id AS a, b.claim_id AS b, {_SIM} AS sim FROM vec a JOIN vec b ON a.claim_id <> b.claim_id
  AND {_SIM} >= {RELATED} AND a.claim_id % 2 = 1 AND (b.claim_id % 2 = 0 OR b.claim_id < a.claim_id)),
seq AS (SELECT claim_id, row_number() OVER (ORDER BY claim_id) AS n FROM vec WHERE claim_id % 2 = 1),
nb AS (SELECT n, claim_id, coalesce(list(b) FILTER (b IS NOT NULL), []) AS near FROM seq LEFT JOIN pre ON a = claim_id AND sim >= {DUPLICATE} GROUP BY 1, 2),
st AS (SELECT 0::BIGINT AS n, (SELECT list(claim_id) FROM vec WHERE claim_id % 2 = 0) AS canon UNION ALL
  SELECT nb.n, CASE WHEN list_has_any(canon, near) THEN canon ELSE list_append(canon, nb.claim_id) END FROM st JOIN nb ON nb.n = st.n + 1),
fin AS (SELECT unnest(canon) AS claim_id FROM (SELECT canon FROM st ORDER BY n DESC LIMIT 1)),
best AS (SELECT a, arg_max(b, (sim, -b)) AS b, max(sim) AS sim FROM pre JOIN fin ON fin.claim_id = b WHERE sim >= {DUPLICATE} GROUP BY 1),
rel AS (SELECT a, list(b ORDER BY rank) AS related FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank
  FROM pre JOIN fin ON fin.claim_id = b WHERE sim < {DUPLICATE} AND a IN (SELECT claim_id FROM fin)) WHERE rank <= 10 GROUP BY 1),
outcome AS (SELECT seq.claim_id, fin.claim_id IS NOT NULL AS is_canonical, CASE WHEN fin.claim_id IS NULL THEN b END AS canonical_claim,
  CASE WHEN fin.claim_id IS NULL THEN sim END AS similarity, coalesce(related, []) AS related
  FROM seq LEFT JOIN fin USING (claim_id) LEFT JOIN best ON best.a = seq.claim_id LEFT JOIN rel ON rel.a = seq.claim_id)"""


@query("g10_incremental_dedup", with_tables("vec", "RECURSIVE " + DEDUP_SQL + """
SELECT claim_id, is_canonical, canonical_claim, round(similarity, 6) AS similarity, related FROM outcome"""))
def g10(spark, d):
    """The first half of the claims is known, the second half arrives in order."""
    claims = B.claim_vectors(spark, d)
    is_new = F.col("claim_id") % 2 == 1
    known = claims.where(~is_new).withColumn("is_canonical", F.lit(True))
    found = D.deduplicate_claims(claims.where(is_new), known, DUPLICATE, RELATED)
    related = F.coalesce(F.col("related.claim_id"), F.array().cast("array<bigint>"))
    return found.select("claim_id", "is_canonical", "canonical_claim", F.round("similarity", 6).alias("similarity"), related.alias("related"))


_MERGES = """
m AS (SELECT claim_id AS dup_id, claim_id - 1 AS canon_id FROM vec WHERE claim_id % 5 = 4),
s AS (SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN 'agrees' END AS user_stance FROM vec WHERE claim_id % 2 = 0 OR claim_id % 3 = 0),
x AS (SELECT m.*, d.claim_id IS NOT NULL AS dup_row, d.user_stance AS ds, coalesce(c.user_stance IS NOT NULL, false) AS canon_rated FROM m
  LEFT JOIN s d ON d.claim_id = dup_id LEFT JOIN s c ON c.claim_id = canon_id)"""


def _merged(spark, d):
    claims = B.claim_vectors(spark, d)
    merges = claims.where(F.col("claim_id") % 5 == 4).select(
        F.col("claim_id").alias("dup_id"), (F.col("claim_id") - 1).alias("canon_id")
    )
    stances = claims.where((F.col("claim_id") % 2 == 0) | (F.col("claim_id") % 3 == 0)).select(
        "claim_id", F.when(F.col("claim_id") % 3 == 0, "agrees").alias("user_stance")
    )
    return D.merge_duplicates(merges, claims, stances)


@query("g12_merge_duplicates", with_tables("vec", _MERGES + """
SELECT dup_id, canon_id, CAST(dup_row AND (NOT canon_rated OR ds IS NULL) AS BIGINT) AS stances_moved, CAST(canon_rated AND ds IS NOT NULL AS BIGINT) AS stance_conflicts FROM x"""))
def g12(spark, d):
    return _merged(spark, d)[2]


@query("g12_merge_edges", with_tables("vec", _MERGES + f"""
SELECT dup_id AS src_id, canon_id AS dst_id, round({_SIM}, 6) AS similarity, 'duplicate' AS relationship
FROM m JOIN vec a ON a.claim_id = dup_id JOIN vec b ON b.claim_id = canon_id"""))
def g12_edges(spark, d):
    return _merged(spark, d)[0].withColumn("similarity", F.round("similarity", 6))


@query("g12_merged_stances", with_tables("vec", _MERGES + """,
go AS (SELECT * FROM x WHERE dup_row AND (NOT canon_rated OR ds IS NULL)),
rows AS (SELECT claim_id, user_stance, 0 AS guest FROM s WHERE claim_id NOT IN (SELECT dup_id FROM go) UNION ALL SELECT canon_id, ds, 1 FROM go)
SELECT claim_id, arg_min(user_stance, guest) AS user_stance FROM rows GROUP BY 1"""))
def g12_stances(spark, d):
    return _merged(spark, d)[1]


# -- contradictions --------------------------------------------------------------------------------------------------


def _values(rows) -> str:
    return ",".join("(" + ",".join(f"'{v}'" for v in row) + ")" for row in rows)


_OPP = "opp(a, b) AS (VALUES " + _values([(a, b) for a, bs in vocab.PREDICATE_OPPOSITES.items() for b in bs]) + ")"
_COMP = "(" + ",".join(f"'{c}'" for c in vocab.COMPARATIVE_PREDICATES) + ")"
_TYPE = f"""CASE WHEN x.subject = y.subject AND x.object = y.object AND EXISTS (SELECT 1 FROM opp WHERE (a = x.predicate AND b = y.predicate) OR (a = y.predicate AND b = x.predicate)) THEN 'direct'
  WHEN x.subject = y.object AND x.object = y.subject AND x.predicate = y.predicate AND x.predicate IN {_COMP} THEN 'comparative' END"""
_CONF = "CASE contradiction_type WHEN 'direct' THEN 0.95 WHEN 'comparative' THEN 0.9 ELSE 0.85 END"
_CONTRA = f"""{_OPP},
pairs AS (SELECT x.claim_id AS claim_id_1, y.claim_id AS claim_id_2, list_cosine_similarity(x.v, y.v) AS similarity, {_TYPE} AS contradiction_type
  FROM vec x JOIN vec y ON x.claim_id < y.claim_id AND list_cosine_similarity(x.v, y.v) >= {CONTRADICT}),
found AS (SELECT claim_id_1, claim_id_2, similarity, contradiction_type, CAST({_CONF} AS DOUBLE) AS confidence FROM pairs WHERE contradiction_type IS NOT NULL),
top AS (SELECT * FROM found ORDER BY confidence DESC, similarity DESC, claim_id_1, claim_id_2 LIMIT 100)"""


@query("i04_structural_pairs", with_tables("claim", f"""{_OPP},
t AS (SELECT subject, predicate, object, min(claim_id) AS claim_id FROM claim GROUP BY 1, 2, 3)
SELECT x.claim_id AS claim_id_1, y.claim_id AS claim_id_2, {_TYPE} AS contradiction_type
FROM t x JOIN t y ON x.claim_id < y.claim_id AND ((x.subject = y.subject AND x.object = y.object) OR (x.subject = y.object AND x.object = y.subject))
WHERE {_TYPE} IS NOT NULL"""))
def i04(spark, d):
    triples = C.upsert_triples(B.claims(spark, d))
    pairs = I.direct_pairs(triples).unionByName(I.comparative_pairs(triples))
    return pairs.select("claim_id_1", "claim_id_2", "contradiction_type")


@query("i04_negation_counts", with_tables("claim", """
t AS (SELECT DISTINCT subject, predicate, object FROM claim)
SELECT subject, predicate, 0 AS pattern, count(*) FILTER (object LIKE 'has %') AS positive, count(*) FILTER (object LIKE 'lacks %') AS negative,
  count(*) FILTER (object LIKE 'has %') * count(*) FILTER (object LIKE 'lacks %') AS pairs FROM t GROUP BY 1, 2
HAVING count(*) FILTER (object LIKE 'has %') > 0 AND count(*) FILTER (object LIKE 'lacks %') > 0"""))
def i04_counts(spark, d):
    return I.negation_counts(C.upsert_triples(B.claims(spark, d)))


@query("i05_contradictions", with_tables("vec", _CONTRA + """
SELECT claim_id_1, claim_id_2, round(similarity, 6) AS similarity, contradiction_type, top.confidence, x.subject AS subject_1, x.predicate AS predicate_1, x.object AS object_1,
  y.subject AS subject_2, y.predicate AS predicate_2, y.object AS object_2 FROM top JOIN vec x ON x.claim_id = claim_id_1 JOIN vec y ON y.claim_id = claim_id_2"""))
def i05(spark, d):
    found = I.detect_contradictions(B.claim_vectors(spark, d), CONTRADICT, 100)
    return found.withColumn("similarity", F.round("similarity", 6))


_NEG_CONTRA = """
w AS (SELECT claim_id, subject, predicate, (CASE (claim_id // 30) % 4 WHEN 0 THEN 'has ' WHEN 1 THEN 'lacks ' WHEN 2 THEN 'is ' ELSE 'is not ' END) || object AS object, v FROM vec)
SELECT x.claim_id AS claim_id_1, y.claim_id AS claim_id_2, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM w x JOIN w y ON x.claim_id < y.claim_id
  AND x.subject = y.subject AND x.predicate = y.predicate AND list_cosine_similarity(x.v, y.v) >= 0.05
  AND ((x.object LIKE 'has %' AND y.object LIKE 'lacks %') OR (x.object LIKE 'lacks %' AND y.object LIKE 'has %')
    OR (x.object LIKE 'is not %' AND y.object LIKE 'is %' AND y.object NOT LIKE 'is not %') OR (y.object LIKE 'is not %' AND x.object LIKE 'is %' AND x.object NOT LIKE 'is not %'))"""


@query("i05_similar_negations", with_tables("vec", _NEG_CONTRA))
def i05_negations(spark, d):
    four = F.floor(F.col("claim_id") / 30) % 4
    prefix = F.when(four == 0, "has ").when(four == 1, "lacks ").when(four == 2, "is ").otherwise("is not ")
    claims = B.claim_vectors(spark, d).withColumn("object", F.concat(prefix, "object"))
    return I.similar_negations(claims, 0.05).withColumn("similarity", F.round("similarity", 6))


@query("i06_contradictions_of", with_tables("vec", _CONTRA + """,
seen AS (SELECT claim_id_1 AS claim_id, claim_id_2 AS other_id, similarity, contradiction_type FROM found UNION ALL SELECT claim_id_2, claim_id_1, similarity, contradiction_type FROM found)
SELECT claim_id, other_id, round(similarity, 6) AS similarity, contradiction_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, other_id) AS rank FROM seen) WHERE rank <= 10"""))
def i06(spark, d):
    claims = B.claim_vectors(spark, d)
    found = I.contradictions_of(claims, claims, CONTRADICT, 10)
    return found.select("claim_id", "other_id", F.round("similarity", 6).alias("similarity"), "contradiction_type", "rank")


VERDICT_SQL = f"""{_CANON}, {_OPP},
old AS (SELECT * FROM canon WHERE claim_id % 3 <> 0),
near AS (SELECT x.claim_id AS claim_id_1, y.claim_id AS claim_id_2, list_cosine_similarity(x.v, y.v) AS similarity, {_TYPE} AS kind,
    row_number() OVER (PARTITION BY x.claim_id ORDER BY list_cosine_similarity(x.v, y.v) DESC, y.claim_id) AS rank
  FROM vec x JOIN old y ON list_cosine_similarity(x.v, y.v) >= {RELATED} AND NOT (x.subject = y.subject AND x.predicate = y.predicate AND x.object = y.object) WHERE x.claim_id % 3 = 0)"""


@query("i07_semantic_verdicts", with_tables("vec", VERDICT_SQL + """
SELECT claim_id_1, claim_id_2, round(similarity, 6) AS similarity, 'semantic' AS contradiction_type, round(0.5 + ((claim_id_1 + claim_id_2) % 5)/10, 4) AS confidence,
  'pair ' || claim_id_1 || '/' || claim_id_2 AS explanation
FROM near WHERE rank <= 5 AND kind IS NULL AND (claim_id_1 + claim_id_2) % 2 = 0 AND round(0.5 + ((claim_id_1 + claim_id_2) % 5)/10, 4) >= 0.7"""))
def i07(spark, d):
    """Verdicts are derived from the pair so that both engines agree on them."""
    claims = B.claim_vectors(spark, d)
    is_new = F.col("claim_id") % 3 == 0
    candidates = I.verification_candidates(claims.where(is_new), claims.where(~is_new), RELATED)
    total = F.col("claim_id_1") + F.col("claim_id_2")
    verdicts = candidates.select(
        "claim_id_1", "claim_id_2", (total % 2 == 0).alias("is_contradiction"), F.round(0.5 + (total % 5) / 10, 4).alias("confidence"),
        F.concat(F.lit("pair "), F.col("claim_id_1").cast("string"), F.lit("/"), F.col("claim_id_2").cast("string")).alias("explanation"),
    )
    return I.confirmed_by_verdicts(candidates, verdicts).withColumn("similarity", F.round("similarity", 6))


def _edges(spark, d):
    found = I.structural_contradictions(B.claim_vectors(spark, d), CONTRADICT)
    return I.contradiction_edges(found, F.lit("2001-11-04").cast("timestamp_ntz"))


@query("d05_stored_contradictions", with_tables("vec", _CONTRA + """
SELECT claim_id_1, claim_id_2, round(similarity, 6) AS similarity, contradiction_type, t.confidence, x.subject AS subject_1, y.subject AS subject_2
FROM (SELECT * FROM found ORDER BY confidence DESC, similarity DESC, claim_id_1, claim_id_2 LIMIT 50) t JOIN vec x ON x.claim_id = claim_id_1 JOIN vec y ON y.claim_id = claim_id_2"""))
def d05(spark, d):
    stored = I.stored_contradictions(_edges(spark, d), B.claim_vectors(spark, d))
    return stored.select(
        "claim_id_1", "claim_id_2", F.round("similarity", 6).alias("similarity"), "contradiction_type", "confidence", "subject_1", "subject_2"
    )


@query("e05_contradiction_stats", with_tables("vec", _CONTRA + """,
told AS (SELECT found.*, subject, predicate FROM found JOIN vec ON claim_id = claim_id_1)
SELECT 'total' AS kind, 'all' AS name, count(*) AS count FROM found
UNION ALL SELECT 'type', t, (SELECT count(*) FROM found WHERE contradiction_type = t) FROM (VALUES ('direct'),('semantic'),('negation'),('comparative')) AS k(t)
UNION ALL SELECT * FROM (SELECT 'subject', subject, count(*) FROM told GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'predicate', predicate, count(*) FROM told GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""))
def e05(spark, d):
    from colloquy.session import materialize

    return I.contradiction_stats(materialize(_edges(spark, d)), B.claim_vectors(spark, d))


# -- clustering and themes ----------------------------------------------------------------------------------------------


def by_label(spark, d):
    """The given labels as a clustering; the last label counts as noise."""
    return B.claim_vectors(spark, d).select(
        F.col("claim_id").alias("id"), F.when(F.col("label") < 9, F.col("label").cast("string")).alias("cluster")
    )


@query("h01_kmeans_facts", with_tables("vec", """
SELECT count(*) AS points, ceil(sqrt(count(*) / 2.0))::BIGINT AS k, count(*) AS assigned, true AS within_k, true AS near_own_center, true AS closer_than_labels FROM vec"""))
def h01_facts(spark, d):
    """What must hold of any k-means result: every point assigned, at most k clusters, points with the nearest
    center but for the last step's few, and members closer to their centers than those of the given labels."""
    claims = B.claim_vectors(spark, d)
    n = claims.count()
    found = materialize(H.kmeans_clusters(claims))
    centers = materialize(H.centroids(claims, found))
    mine = H.memberships(claims, found, centers)
    best = G.search_themes(
        centers.select(F.col("cluster").alias("theme_id"), "centroid", F.lit(True).alias("is_active"), F.lit("").alias("name"), "claim_count"),
        _queries(claims), 1, -1.0,
    ).select(F.col("query_id").alias("claim_id"), F.col("similarity").alias("best"))
    labelled = by_label(spark, d)
    other = H.memberships(claims, labelled, H.centroids(claims, labelled)).agg(F.avg("membership_score").alias("theirs"))
    told = mine.join(best, "claim_id").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_distinct("cluster").alias("clusters"), F.avg("membership_score").alias("ours"),
        F.avg((F.col("best") - F.col("membership_score") > 1e-6).cast("double")).alias("elsewhere"),
    )
    return told.crossJoin(other).select(
        F.lit(n).cast("long").alias("points"), F.lit(H.automatic_k(n)).cast("long").alias("k"), "assigned",
        (F.col("clusters") <= H.automatic_k(n)).alias("within_k"), (F.col("elsewhere") <= 0.05).alias("near_own_center"),
        (F.col("ours") > F.col("theirs")).alias("closer_than_labels"),
    )


@query("h01_kmeans")
def h01(spark, d):
    return H.kmeans_clusters(B.claim_vectors(spark, d))


_GRAPH = f"""
adj AS (SELECT a.claim_id AS u, b.claim_id AS w FROM vec a JOIN vec b ON a.claim_id <> b.claim_id AND list_cosine_similarity(a.v, b.v) >= {{sim}}),
"""
_REACH = """reach(id, label) AS (SELECT id, id FROM nodes UNION SELECT e.w, r.label FROM reach r JOIN links e ON e.u = r.id),
comp AS (SELECT id, min(label) AS cluster FROM reach GROUP BY 1)"""


@query("h02_dbscan", with_tables("vec", "RECURSIVE " + _GRAPH.format(sim=1 - EPSILON) + """
deg AS (SELECT u, count(*) AS n FROM adj GROUP BY 1), nodes AS (SELECT u AS id FROM deg WHERE n >= 3),
links AS (SELECT u, w FROM adj WHERE u IN (SELECT id FROM nodes) AND w IN (SELECT id FROM nodes)),
""" + _REACH + """,
border AS (SELECT u AS id, min(cluster) AS cluster FROM adj JOIN comp ON comp.id = w WHERE u NOT IN (SELECT id FROM nodes) GROUP BY 1)
SELECT claim_id AS id, coalesce(comp.cluster, border.cluster) AS cluster, comp.id IS NOT NULL AS is_core
FROM vec LEFT JOIN comp ON comp.id = claim_id LEFT JOIN border ON border.id = claim_id"""))
def h02(spark, d):
    return H.dbscan_clusters(B.claim_vectors(spark, d), EPSILON, 3)


_CGRAPH = f"""
adj AS (SELECT a.claim_id AS u, b.claim_id AS w FROM cvec a JOIN cvec b ON a.claim_id <> b.claim_id AND a.nz AND b.nz AND list_cosine_similarity(a.v, b.v) >= {{sim}}),
"""


@query("h02_dbscan_copies", with_tables("cvec", "RECURSIVE " + _CGRAPH.format(sim=1 - EPSILON) + """
deg AS (SELECT u, count(*) AS n FROM adj GROUP BY 1), nodes AS (SELECT u AS id FROM deg WHERE n >= 3),
links AS (SELECT u, w FROM adj WHERE u IN (SELECT id FROM nodes) AND w IN (SELECT id FROM nodes)),
""" + _REACH + """,
border AS (SELECT u AS id, min(cluster) AS cluster FROM adj JOIN comp ON comp.id = w WHERE u NOT IN (SELECT id FROM nodes) GROUP BY 1)
SELECT claim_id AS id, coalesce(comp.cluster, border.cluster) AS cluster, comp.id IS NOT NULL AS is_core
FROM cvec LEFT JOIN comp ON comp.id = claim_id LEFT JOIN border ON border.id = claim_id"""))
def h02_copies(spark, d):
    return H.dbscan_clusters(B.copied_vectors(spark, d), EPSILON, 3)


@query("h03_single_copies", with_tables("cvec", "RECURSIVE " + _CGRAPH.format(sim=LINKAGE) + """
nodes AS (SELECT claim_id AS id FROM cvec), links AS (SELECT * FROM adj),
""" + _REACH + " SELECT id, cluster FROM comp"))
def h03_copies(spark, d):
    return H.single_linkage(B.copied_vectors(spark, d), LINKAGE)


@query("h03_single_linkage", with_tables("vec", "RECURSIVE " + _GRAPH.format(sim=LINKAGE) + """
nodes AS (SELECT claim_id AS id FROM vec), links AS (SELECT * FROM adj),
""" + _REACH + " SELECT id, cluster FROM comp"))
def h03(spark, d):
    return H.single_linkage(B.claim_vectors(spark, d), LINKAGE)


_LINK = """
sims AS (SELECT a.claim_id AS i, b.claim_id AS j, list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.claim_id < b.claim_id),
st AS (
  SELECT claim_id AS id, claim_id AS c, 0 AS n FROM vec
  UNION ALL
  SELECT st.id, CASE WHEN st.c = m.b THEN m.a ELSE st.c END, st.n + 1 FROM st, (
    SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, {fold}(s) AS v FROM sims JOIN st x ON x.id = i JOIN st y ON y.id = j
    WHERE x.c <> y.c GROUP BY 1, 2 HAVING {fold}(s) >= {sim} ORDER BY v DESC, a, b LIMIT 1) m)
SELECT id, c AS cluster FROM st WHERE n = (SELECT max(n) FROM st)"""


@query("h03_average_linkage", with_tables("vec", "RECURSIVE " + _LINK.format(fold="avg", sim=LINKAGE)))
def h03_average(spark, d):
    return H.average_linkage(B.claim_vectors(spark, d), LINKAGE)


@query("h03_complete_linkage", with_tables("vec", "RECURSIVE " + _LINK.format(fold="min", sim=LINKAGE)))
def h03_complete(spark, d):
    return H.complete_linkage(B.claim_vectors(spark, d), LINKAGE)


@query("h04_silhouette", with_tables("vec", """
k AS (SELECT *, CASE WHEN label < 9 THEN label END AS c FROM vec),
pd AS (SELECT a.claim_id, a.c AS own, b.c AS other, avg(1 - list_cosine_similarity(a.v, b.v)) AS d FROM k a JOIN k b ON a.claim_id <> b.claim_id
  WHERE a.c IS NOT NULL AND b.c IS NOT NULL GROUP BY 1, 2, 3),
ab AS (SELECT claim_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM pd GROUP BY 1)
SELECT round(avg((b - a)/greatest(a, b)), 6) AS silhouette, count(*) AS points FROM ab WHERE a IS NOT NULL AND b IS NOT NULL"""))
def h04(spark, d):
    return H.silhouette(B.claim_vectors(spark, d), by_label(spark, d)).withColumn("silhouette", F.round("silhouette", 6))


_CENTER = """
k AS (SELECT *, label::VARCHAR AS c FROM vec WHERE label < 9),
x AS (SELECT c, pos, avg(v[pos]) AS m FROM k, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM vec))) AS pos) GROUP BY 1, 2),
ctr AS (SELECT c, list(m ORDER BY pos) AS mean FROM x GROUP BY 1)"""


@query("e14_centroids", with_tables("vec", _CENTER + """
SELECT c AS cluster, round(mean[1]/sqrt(list_dot_product(mean, mean)), 6) AS first_component, round(mean[64]/sqrt(list_dot_product(mean, mean)), 6) AS last_component,
  (SELECT count(*) FROM k WHERE k.c = ctr.c) AS claim_count FROM ctr"""))
def e14(spark, d):
    centers = H.centroids(B.claim_vectors(spark, d), by_label(spark, d))
    return centers.select(
        "cluster", F.round(F.element_at("centroid", 1), 6).alias("first_component"),
        F.round(F.element_at("centroid", -1), 6).alias("last_component"), "claim_count",
    )


def _themes(spark, d):
    claims = B.claim_vectors(spark, d)
    return (claims, *H.build_themes(claims, by_label(spark, d), "run1", F.col("claim_id"), 3))


LABEL_SQL = _CENTER + """,
s AS (SELECT c, subject, count(*) AS n, min(claim_id) AS f FROM k GROUP BY 1, 2), p AS (SELECT c, predicate, count(*) AS n, min(claim_id) AS f FROM k GROUP BY 1, 2),
lab AS (SELECT c, arg_min(subject, (-n, f)) AS subject, list_slice(list(subject ORDER BY f), 1, 5) AS keywords FROM s GROUP BY 1),
pre AS (SELECT c, arg_min(predicate, (-n, f)) AS predicate FROM p GROUP BY 1),
theme AS (SELECT 'theme:run1_' || c AS theme_id, subject || ' Topics' AS name, 'Claims where various subjects ' || replace(predicate,'-',' ') || ' ' || subject AS description,
  keywords, (SELECT count(*) FROM k WHERE k.c = lab.c) AS claim_count, c FROM lab JOIN pre USING (c)),
member AS (SELECT claim_id, 'theme:run1_' || k.c AS theme_id, list_cosine_similarity(v, mean) AS membership_score FROM k JOIN ctr ON ctr.c = k.c)"""


@query("h05_themes", with_tables("vec", LABEL_SQL + " SELECT theme_id, name, description, keywords, claim_count FROM theme"))
def h05(spark, d):
    _, themes, _, _ = _themes(spark, d)
    return themes.select("theme_id", "name", "description", "keywords", "claim_count")


_OWN = LABEL_SQL.replace(
    "k AS (SELECT *, label::VARCHAR AS c FROM vec WHERE label < 9)",
    """k AS (SELECT vec.*, cluster::VARCHAR AS c FROM vec JOIN comp ON comp.id = claim_id
  WHERE cluster IN (SELECT cluster FROM comp GROUP BY 1 HAVING count(*) >= 3))""",
)


@query("h05_own_themes", with_tables("vec", "RECURSIVE " + _GRAPH.format(sim=LINKAGE) + "nodes AS (SELECT claim_id AS id FROM vec), links AS (SELECT * FROM adj),\n"
    + _REACH + "," + _OWN + " SELECT theme_id, name, description, keywords, claim_count FROM theme"))
def h05_own(spark, d):
    """Themes of the clusters that single linkage finds, not of given labels."""
    claims = B.claim_vectors(spark, d)
    clusters = H.single_linkage(claims, LINKAGE).withColumn("cluster", F.col("cluster").cast("string"))
    _, themes, _, _ = (claims, *H.build_themes(claims, clusters, "run1", F.col("claim_id"), 3))
    return themes.select("theme_id", "name", "description", "keywords", "claim_count")


@query("h05_memberships", with_tables("vec", LABEL_SQL + " SELECT claim_id, theme_id, round(membership_score, 6) AS membership_score FROM member"))
def h05_members(spark, d):
    return _themes(spark, d)[2].withColumn("membership_score", F.round("membership_score", 6))


@query("h05_unclustered", with_tables("vec", "SELECT claim_id FROM vec WHERE label >= 9"))
def h05_unclustered(spark, d):
    return _themes(spark, d)[3]


@query("h08_theme_list", with_tables("vec", LABEL_SQL + " SELECT theme_id, name, claim_count FROM theme ORDER BY claim_count DESC, theme_id"))
def h08(spark, d):
    _, themes, _, _ = _themes(spark, d)
    return H.theme_list(themes).select("theme_id", "name", "claim_count")


@query("h07_published_themes", with_tables("vec", LABEL_SQL + """
SELECT theme_id, is_active FROM (SELECT theme_id, true AS is_active FROM theme UNION ALL SELECT replace(theme_id, 'run1', 'run0'), false FROM theme)"""))
def h07(spark, d):
    _, themes, _, _ = _themes(spark, d)
    earlier = themes.withColumn("theme_id", F.replace(F.col("theme_id"), F.lit("run1"), F.lit("run0")))
    return H.publish_themes(earlier, themes).select("theme_id", "is_active")


@query("d06_theme_members", with_tables("vec", LABEL_SQL + """
SELECT claim_id, theme_id, round(membership_score, 6) AS membership_score, subject, predicate, object FROM
 (SELECT * FROM member WHERE theme_id = 'theme:run1_3' ORDER BY membership_score DESC, claim_id LIMIT 20 OFFSET 5) JOIN vec USING (claim_id)"""))
def d06(spark, d):
    claims, _, members, _ = _themes(spark, d)
    page = H.theme_members(members, claims, "theme:run1_3", 20, 5)
    return page.withColumn("membership_score", F.round("membership_score", 6))


_EVERY = LABEL_SQL + """,
every AS (SELECT claim_id, 'theme:run1_' || ctr.c AS theme_id, list_cosine_similarity(v, mean) AS score FROM vec, ctr)"""


@query("d07_best_theme", with_tables("vec", LABEL_SQL + """
SELECT claim_id, theme_id, name, round(membership_score, 6) AS membership_score FROM member JOIN theme USING (theme_id)"""))
def d07(spark, d):
    _, themes, members, _ = _themes(spark, d)
    return G.best_theme(members, themes).withColumn("membership_score", F.round("membership_score", 6))


@query("g13_theme_search", with_tables("vec", _EVERY + """
SELECT query_id, theme_id, name, claim_count, round(score, 6) AS similarity, rank FROM (SELECT claim_id AS query_id, e.*, name, claim_count,
  row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, theme_id) AS rank FROM every e JOIN theme USING (theme_id) WHERE score >= 0.2) WHERE rank <= 3"""))
def g13(spark, d):
    claims, themes, _, _ = _themes(spark, d)
    return G.search_themes(themes, _queries(claims), 3, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("e06_theme_stats", with_tables("vec", LABEL_SQL + """
SELECT count(*) AS themes, sum(claim_count)::BIGINT AS clustered_claims, round(avg(claim_count), 6) AS avg_claims, arg_min(name, (-claim_count, theme_id)) AS largest_theme FROM theme"""))
def e06(spark, d):
    _, themes, _, _ = _themes(spark, d)
    return H.theme_stats(themes).withColumn("avg_claims", F.round("avg_claims", 6))


@query("e11_most_frequent", with_tables("claim", """
c AS (SELECT subject, predicate, count(*) AS n, min(claim_id) AS f FROM claim GROUP BY 1, 2)
SELECT subject, arg_min(predicate, (-n, f)) AS predicate, max(n) AS n FROM c GROUP BY 1"""))
def e11(spark, d):
    return H.most_frequent(B.claims(spark, d), "subject", "predicate", "claim_id")
