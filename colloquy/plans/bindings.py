"""Engine tables as expressions over the given parquet tables.

Every binding is narrow (one or two scans, equi-joins only), so the work of each registered query
grows with its input tables. The SQL twins for the oracle live in `oracle.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import read_table

PREDICATES = [
    "supports", "opposes", "is-better-than", "is-worse-than", "has", "lacks",
    "uses", "abandoned", "is-faster-than", "released", "announced", "claims",
]
VECTOR_PREDICATES = ["supports", "opposes", "is-better-than", "has", "lacks", "uses"]
POST_SIZE = 64  # events per post


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(column: Column, n: int) -> Column:
    return F.floor(column / n)


def _claim_id() -> Column:
    """Order and line repeat in the data; part, supplier and price make the id unique."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")] + [cents]
    return F.concat(F.lit("claim:"), F.concat_ws("_", *[p.cast("string") for p in parts]))


def claims(spark: SparkSession, base: str) -> DataFrame:
    part = read_table(spark, base, "part").select("p_partkey", "p_brand")
    items = read_table(spark, base, "lineitem")
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    five = F.col("l_partkey") % 5
    prefix = F.when(five == 0, "has ").when(five == 1, "lacks ").otherwise("")
    return joined.select(
        _claim_id().alias("claim_id"),
        F.col("p_brand").alias("subject"),
        _pick(PREDICATES, (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_suppkey")) % 12).alias("predicate"),
        F.concat(prefix, F.lit("Brand#"), (F.lit(1) + F.col("l_suppkey") % 25).cast("string")).alias("object"),
        F.round(1 - 6 * F.col("l_discount"), 4).alias("confidence"),
        F.col("l_shipdate").alias("extracted_at"),
        F.concat(F.lit("p"), _div(F.col("l_orderkey"), POST_SIZE).cast("string")).alias("post_id"),
        (F.col("l_linenumber") != 7).alias("is_canonical"),
        F.when(F.col("l_quantity") >= 10, F.array("l_discount", "l_tax").cast("array<float>")).alias("embedding"),
        _pick(["agrees", "disagrees", "neutral", "uncertain"], F.col("l_suppkey") % 4).alias("source_stance"),
    )


def stances(spark: SparkSession, base: str) -> DataFrame:
    items = read_table(spark, base, "lineitem").where("l_returnflag <> 'N'")
    return items.select(
        _claim_id().alias("claim_id"),
        F.when(F.col("l_tax") > 0.02, "agrees").alias("content_author_stance"),
        F.round(F.col("l_tax") * 100, 2).alias("commenter_agree_pct"),
        F.round(F.col("l_discount") * 100, 2).alias("commenter_disagree_pct"),
        F.when(
            F.col("l_orderkey") % 5 > 0,
            _pick(["agrees", "disagrees", "neutral", "uncertain"], F.col("l_orderkey") % 5 - 1),
        ).alias("user_stance"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("note "), F.col("l_suppkey").cast("string"))).alias("user_note"),
    )


def claim_vectors(spark: SparkSession, base: str) -> DataFrame:
    return claim_columns(read_table(spark, base, "embeddings"))


def claim_columns(embeddings: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return embeddings.select(
        v.alias("claim_id"),
        F.concat(F.lit("S"), (v % 5).cast("string")).alias("subject"),
        _pick(VECTOR_PREDICATES, _div(v, 5) % 6).alias("predicate"),
        F.concat(F.lit("S"), (_div(v, 30) % 5).cast("string")).alias("object"),
        F.round(0.4 + (v % 7) / 10, 4).alias("confidence"),
        F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, cast(vec_id as int))").alias("extracted_at"),
        F.col("embedding"),
        (v % 50 != 49).alias("is_canonical"),
        F.when(v % 50 == 49, v - 1).alias("canonical_claim"),
        F.col("label"),
    )


def copied_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Claim vectors with zero vectors, one vector shared by a quarter of all rows, and exact copies."""
    claims = claim_vectors(spark, base)
    c, v = F.col("claim_id"), F.col("embedding").cast("array<double>")
    axis = F.transform(v, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    changed = claims.withColumn(
        "embedding", F.when(c % 50 == 7, F.transform(v, lambda x: F.lit(0.0))).when(c % 4 == 1, axis).otherwise(v)
    )
    return changed.unionByName(changed.where(c % 7 == 0).withColumn("claim_id", c + 1_000_000))


def _events(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "events")


def posts(spark: SparkSession, base: str) -> DataFrame:
    """One post per document, titled by its first line; the events are comments of the first posts."""
    grouped = (
        _events(spark, base)
        .groupBy(_div(F.col("event_id"), POST_SIZE).alias("post_no"))
        .agg(
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
            F.count(F.lit(1)).alias("num_comments"),
            F.min("ts").alias("created_at"),
        )
    )
    docs = read_table(spark, base, "documents").select(
        F.col("doc_id").alias("post_no"), "text", F.col("source").alias("subreddit")
    )
    pages = read_table(spark, base, "pages").select(F.col("page_id").alias("post_no"), "url")
    joined = docs.join(grouped, "post_no", "left").join(pages, "post_no", "left")
    since = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(post_no % 720 as int))")
    cents = F.coalesce("cents", F.col("post_no") * 37)
    return joined.select(
        "post_no",
        F.concat(F.lit("p"), F.col("post_no").cast("string")).alias("post_id"),
        "subreddit",
        F.regexp_extract("text", r"^[^\r\n]*", 0).alias("title"),
        F.when(F.col("post_no") % 5 == 0, "").otherwise(F.col("text")).alias("content"),
        F.concat(F.lit("u"), (F.col("post_no") % 97).cast("string")).alias("author"),
        F.coalesce("url", F.lit("")).alias("url"),
        _div(cents % 20000, 100).alias("score"),
        F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        F.coalesce(F.col("created_at").cast("timestamp_ntz"), since).alias("created_at"),
        F.col("post_no").alias("feed_pos"),
    )


def comments(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", spread=True).select("doc_id", "text")
    events = read_table(spark, base, "events", spread=True).withColumn("doc_id", _div(F.col("event_id"), 10))
    e = F.col("event_id")
    post_no = _div(e, POST_SIZE)
    rank = e % POST_SIZE
    kind = F.col("event_type")
    phrase = (
        F.when(kind == "error", "I disagree, this is wrong and misleading; rust is slow ")
        .when(kind == "purchase", "love this, great work ")
        .when(kind == "view", "terrible, worst take. golang vs rust ")
        .otherwise("")
    )
    return events.join(docs, "doc_id").select(
        F.concat(F.lit("c"), e.cast("string")).alias("comment_id"),
        F.concat(F.lit("p"), post_no.cast("string")).alias("post_id"),
        F.when(rank >= 6, F.concat(F.lit("t1_c"), (post_no * POST_SIZE + _div(rank, 2)).cast("string")))
        .otherwise(F.concat(F.lit("t3_p"), post_no.cast("string"))).alias("parent_id"),
        F.when(e % 23 == 0, "[deleted]").otherwise(F.concat(F.lit("u"), (e % 97).cast("string"))).alias("author"),
        F.concat(phrase, F.col("text")).alias("body"),
        F.floor(F.col("value") * 2 - 60).alias("score"),
        F.col("ts").alias("created_at"),
    )


def summaries(spark: SparkSession, base: str) -> DataFrame:
    p = posts(spark, base)
    n = F.col("post_no")
    topics = F.filter(F.slice(F.split(F.lower("title"), r"\s+"), 1, 5), lambda t: t != "")
    return p.select(
        "post_id", "post_no", "subreddit", "title", "url", "score", "num_comments",
        F.to_date("created_at").alias("digest_date"),
        F.col("content").alias("summary"),
        _pick(["positive", "negative", "mixed", "neutral"], n % 4).alias("sentiment"),
        F.concat(topics, F.array(F.concat(F.lit(" Topic "), (n % 6).cast("string")))).alias("key_topics"),
        F.round(0.5 + (n % 5) / 10, 4).alias("confidence"),
        _pick(["none", "low", "medium", "high"], _div(n, 3) % 4).alias("controversy_level"),
        _pick(["sparse", "moderate", "rich"], n % 3).alias("information_density"),
        F.array(F.concat(F.lit("context "), (n % 3).cast("string")), F.lit("dates <unclear>")).alias("missing_context"),
    )


def llm_usage(spark: SparkSession, base: str) -> DataFrame:
    return _events(spark, base).select(
        F.col("event_id").alias("seq"),
        F.to_date("ts").alias("run_date"),
        F.ceil(F.col("value") * 400).alias("input_tokens"),
        F.ceil(F.col("value") * 20).alias("output_tokens"),
    )


def requests(spark: SparkSession, base: str) -> DataFrame:
    """Search requests per user for the rate audit; time runs 40,000 times faster than the events."""
    return request_columns(_events(spark, base))


def request_columns(events: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    return events.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("client"),
        F.col("event_id").alias("request_id"),
        F.floor(micros / 40_000_000).cast("bigint").alias("at_ms"),
    )


def responses(spark: SparkSession, base: str) -> DataFrame:
    """Documents wrapped as model responses in five ways by document number, some with wrong types."""
    docs = read_table(spark, base, "documents", spread=True)
    d = F.col("doc_id")
    body = F.to_json(F.struct(
        F.col("text").alias("summary"),
        _pick(["positive", "negative", "mixed", "neutral"], d % 4).alias("sentiment"),
        F.array(F.col("lang"), F.col("source")).alias("key_topics"),
    ))
    wrong_number = F.to_json(F.struct(F.col("text").alias("summary"), F.lit("high").alias("confidence")))
    wrong_list = F.to_json(F.struct(F.col("text").alias("summary"), F.col("lang").alias("key_topics")))
    wrapped = (
        F.when(d % 15 == 5, wrong_number)
        .when(d % 15 == 10, wrong_list)
        .when(d % 5 == 0, body)
        .when(d % 5 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(d % 5 == 2, F.concat(F.lit("Sure. "), body, F.lit(" Hope this helps.")))
        .when(d % 5 == 3, F.concat(F.lit("Result "), body, F.lit(" and a stray } brace")))
        .otherwise(F.concat(F.lit("{ broken "), F.col("text")))
    )
    return docs.select("doc_id", "text", "lang", "source", wrapped.alias("response_text"))


def links(spark: SparkSession, base: str) -> DataFrame:
    """Link posts over stored pages; some urls point at blocked or internal hosts."""
    pages = read_table(spark, base, "pages", spread=True)
    n = F.col("page_id")
    url = (
        F.when(n % 10 == 1, F.concat(F.lit("https://www.twitter.com/t/"), n.cast("string")))
        .when(n % 10 == 3, F.concat(F.lit("http://169.254.169.254/meta/"), n.cast("string")))
        .when(n % 10 == 5, F.concat(F.lit("http://10.0.0."), (n % 250).cast("string"), F.lit("/x")))
        .when(n % 10 == 7, F.concat(F.lit("https://www.medium.com/p/"), n.cast("string")))
        .otherwise(F.col("url"))
    )
    return pages.select(
        F.concat(F.lit("l"), n.cast("string")).alias("post_id"), url.alias("url"), n.alias("page_id"), "html",
        F.when(n % 4 == 0, F.col("url")).otherwise("").alias("content"),
    )


def conversations(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "conversations")
