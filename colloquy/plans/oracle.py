"""SQL twins of the bindings, as common table expressions for DuckDB."""

from __future__ import annotations

_ID = "'claim:' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(round(l_extendedprice*100) AS BIGINT)"

CTES: dict[str, str] = {
    "claim": f"""
claim AS (
  SELECT {_ID} AS claim_id, p_brand AS subject,
    (['supports','opposes','is-better-than','is-worse-than','has','lacks','uses','abandoned',
      'is-faster-than','released','announced','claims'])[1 + (l_orderkey*7 + l_linenumber*3 + l_suppkey) % 12] AS predicate,
    (CASE l_partkey % 5 WHEN 0 THEN 'has ' WHEN 1 THEN 'lacks ' ELSE '' END) || 'Brand#' || (1 + l_suppkey % 25) AS object,
    round(1 - 6*l_discount, 4) AS confidence, l_shipdate AS extracted_at, 'p' || (l_orderkey // 64) AS post_id,
    l_linenumber <> 7 AS is_canonical, l_quantity >= 10 AS has_embedding,
    (['agrees','disagrees','neutral','uncertain'])[1 + l_suppkey % 4] AS source_stance
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "stance": f"""
stance AS (
  SELECT {_ID} AS claim_id, CASE WHEN l_tax > 0.02 THEN 'agrees' END AS content_author_stance,
    round(l_tax*100, 2) AS commenter_agree_pct, round(l_discount*100, 2) AS commenter_disagree_pct,
    CASE WHEN l_orderkey % 5 > 0 THEN (['agrees','disagrees','neutral','uncertain'])[l_orderkey % 5] END AS user_stance,
    CASE WHEN l_orderkey % 3 = 0 THEN 'note ' || l_suppkey END AS user_note
  FROM lineitem WHERE l_returnflag <> 'N')""",
    "vec": """
vec AS (
  SELECT vec_id AS claim_id, 'S' || (vec_id % 5) AS subject,
    (['supports','opposes','is-better-than','has','lacks','uses'])[1 + (vec_id // 5) % 6] AS predicate,
    'S' || ((vec_id // 30) % 5) AS object, round(0.4 + (vec_id % 7)/10, 4) AS confidence,
    TIMESTAMP '2001-01-01 00:00:00' + to_hours(CAST(vec_id AS INT)) AS extracted_at,
    CAST(embedding AS DOUBLE[]) AS v, vec_id % 50 <> 49 AS is_canonical,
    CASE WHEN vec_id % 50 = 49 THEN vec_id - 1 END AS canonical_claim, label
  FROM embeddings)""",
    # `nz` tells vectors that are similar to anything at all.
    "cvec": """
cvec AS (
  SELECT *, list_dot_product(v, v) > 0 AS nz FROM (
    WITH m AS (SELECT claim_id, CASE WHEN claim_id % 50 = 7 THEN list_transform(v, lambda x: 0.0::DOUBLE)
      WHEN claim_id % 4 = 1 THEN list_transform(v, lambda x, i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE v END AS v FROM vec)
    SELECT * FROM m UNION ALL SELECT claim_id + 1000000, v FROM m WHERE claim_id % 7 = 0))""",
    "post": """
post AS (
  SELECT post_no, 'p' || post_no AS post_id, source AS subreddit,
    regexp_extract(text, '^[^\\r\\n]*') AS title,
    CASE WHEN post_no % 5 = 0 THEN '' ELSE text END AS content, 'u' || (post_no % 97) AS author,
    coalesce(url, '') AS url, (coalesce(cents, post_no*37) % 20000) // 100 AS score, coalesce(num_comments, 0) AS num_comments,
    coalesce(created_at, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(post_no % 720 AS INT))) AS created_at, post_no AS feed_pos
  FROM (SELECT doc_id AS post_no, * FROM documents) LEFT JOIN (
    SELECT event_id // 64 AS post_no, sum(CAST(round(value*100) AS BIGINT))::BIGINT AS cents, count(*) AS num_comments,
           min(ts) AS created_at FROM events GROUP BY 1) g USING (post_no)
  LEFT JOIN pages ON page_id = post_no)""",
    "comment": """
comment AS (
  SELECT 'c' || event_id AS comment_id, 'p' || (event_id // 64) AS post_id,
    CASE WHEN event_id % 64 >= 6 THEN 't1_c' || ((event_id // 64)*64 + (event_id % 64) // 2)
         ELSE 't3_p' || (event_id // 64) END AS parent_id,
    CASE WHEN event_id % 23 = 0 THEN '[deleted]' ELSE 'u' || (event_id % 97) END AS author,
    (CASE event_type WHEN 'error' THEN 'I disagree, this is wrong and misleading; rust is slow '
       WHEN 'purchase' THEN 'love this, great work ' WHEN 'view' THEN 'terrible, worst take. golang vs rust '
       ELSE '' END) || text AS body,
    CAST(floor(value*2 - 60) AS BIGINT) AS score, ts AS created_at, event_id
  FROM events JOIN documents ON doc_id = event_id // 10)""",
    "summary": """
summary AS (
  SELECT post_id, post_no, subreddit, title, url, score, num_comments, CAST(created_at AS DATE) AS digest_date,
    content AS summary, (['positive','negative','mixed','neutral'])[1 + post_no % 4] AS sentiment,
    list_filter(list_slice(string_split_regex(lower(title), '\\s+'), 1, 5), lambda t: t <> '') || [' Topic ' || (post_no % 6)] AS key_topics,
    round(0.5 + (post_no % 5)/10, 4) AS confidence,
    (['none','low','medium','high'])[1 + (post_no // 3) % 4] AS controversy_level,
    (['sparse','moderate','rich'])[1 + post_no % 3] AS information_density,
    ['context ' || (post_no % 3), 'dates <unclear>'] AS missing_context
  FROM post)""",
    "usage": """
usage AS (
  SELECT event_id AS seq, CAST(ts AS DATE) AS run_date, CAST(ceil(value*400) AS BIGINT) AS input_tokens,
    CAST(ceil(value*20) AS BIGINT) AS output_tokens FROM events)""",
    "link": """
link AS (
  SELECT 'l' || page_id AS post_id, page_id, html, CASE WHEN page_id % 4 = 0 THEN url ELSE '' END AS content,
    CASE page_id % 10 WHEN 1 THEN 'https://www.twitter.com/t/' || page_id
      WHEN 3 THEN 'http://169.254.169.254/meta/' || page_id WHEN 5 THEN 'http://10.0.0.' || (page_id % 250) || '/x'
      WHEN 7 THEN 'https://www.medium.com/p/' || page_id ELSE url END AS url
  FROM pages)""",
    # Every node of the comment forest with its root and depth (root depth 0).
    "tree": """
tree AS (
  SELECT comment_id, post_id, comment_id AS root_id, 0 AS depth, [comment_id] AS path
  FROM comment c WHERE NOT EXISTS (
    SELECT 1 FROM comment p WHERE p.comment_id = regexp_replace(c.parent_id, '^t[13]_', ''))
  UNION ALL
  SELECT c.comment_id, c.post_id, t.root_id, t.depth + 1, list_append(t.path, c.comment_id)
  FROM comment c JOIN tree t ON t.comment_id = regexp_replace(c.parent_id, '^t[13]_', ''))""",
    # Subtree totals of every node: itself and all descendants.
    "subtree": """
subtree AS (
  SELECT a.id AS comment_id, sum(c.score)::BIGINT AS total_score, count(*) - 1 AS reply_count,
    max(t.depth) - min(t.depth) + 1 AS height, count(DISTINCT c.author) AS participants
  FROM (SELECT comment_id, unnest(path) AS id FROM tree) a
  JOIN comment c ON c.comment_id = a.comment_id JOIN tree t ON t.comment_id = a.comment_id GROUP BY 1)""",
}

_NEEDS = {"cvec": ["vec"], "summary": ["post"], "tree": ["comment"], "subtree": ["comment", "tree"]}


def with_tables(names: str, body: str) -> str:
    """`WITH <the named bindings and what they need> <body>`; body may start with more CTEs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    recursive = "RECURSIVE " if "tree" in wanted or "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE", "", 1).strip()
    joiner = "" if body.upper().startswith("SELECT") else ","
    return f"WITH {recursive}" + ",".join(CTES[n].strip() for n in wanted) + joiner + "\n" + body
