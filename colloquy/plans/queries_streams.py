"""Registered queries: streams over the given tables, run to the end of what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy.operators.claim_store import ClaimStore
from colloquy.operators.rate_limit import rate_limit_audit
from colloquy.plans import bindings as B
from colloquy.plans.oracle import with_tables
from colloquy.plans.queries_semantic import DEDUP_SQL
from colloquy.plans.registry import query
from colloquy.session import ensure_checkpoint_dir
from colloquy.streaming import jobs


def _work_folder(spark) -> str:
    """A new folder beside the checkpoints, in storage every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    schema = B.read_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("n04_usage_stream", with_tables("usage", """
SELECT run_date, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS requests,
  round(sum(input_tokens)/1e6*3.0 + sum(output_tokens)/1e6*15.0, 6) AS cost_usd FROM usage GROUP BY 1"""))
def n04_stream(spark, d):
    folder = _work_folder(spark)
    usage = _event_stream(spark, d).select(
        "ts", F.ceil(F.col("value") * 400).alias("input_tokens"), F.ceil(F.col("value") * 20).alias("output_tokens")
    )
    jobs.start(usage, jobs.write_totals(f"{folder}/totals"), f"{folder}/state").awaitTermination()
    return jobs.read_totals(spark, f"{folder}/totals").withColumn("cost_usd", F.round("cost_usd", 6))


_RATE = """
WITH RECURSIVE req AS (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY at_ms, request_id) AS n FROM (
    SELECT 's' || user_id AS client, event_id AS request_id,
      CAST(floor((epoch_us(ts) - 1704067200000000)/40000000) AS BIGINT) AS at_ms FROM events)),
st AS (
  SELECT client, 0::BIGINT AS n, []::BIGINT[] AS recent, 0::BIGINT AS request_id, 0::BIGINT AS at_ms, true AS admitted FROM req WHERE n = 1
  UNION ALL
  SELECT client, n, CASE WHEN len(f) < 30 THEN list_append(f, at_ms) ELSE f END, request_id, at_ms, len(f) < 30 FROM (
    SELECT r.*, list_filter(st.recent, lambda x: r.at_ms - x < 60000) AS f FROM st JOIN req r ON r.client = st.client AND r.n = st.n + 1))
SELECT client, request_id, at_ms, admitted FROM st WHERE n > 0"""


@query("n05_rate_audit", _RATE)
def n05(spark, d):
    return rate_limit_audit(B.requests(spark, d))


@query("n05_rate_audit_stream", _RATE)
def n05_stream(spark, d):
    folder = _work_folder(spark)
    requests = B.request_columns(_event_stream(spark, d))
    jobs.start(requests, jobs.audit_requests(folder), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/audit").drop("batch")


@query("n06_ingest_stream", """
SELECT 'u' || user_id AS author_id, event_type AS kind, CAST(arg_max(floor(value), (ts, event_id)) AS BIGINT) AS score, CAST(min(ts) AS DATE) AS day
FROM events GROUP BY 1, 2, CAST(ts AS DATE)""")
def n06(spark, d):
    """Events of one author, kind and day are versions of one row; the latest score stays."""
    folder = _work_folder(spark)
    rows = _event_stream(spark, d).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author_id"), F.col("event_type").alias("kind"),
        F.floor("value").alias("score"), F.to_date("ts").alias("day"), "ts", "event_id",
    )
    seen = rows.withColumn("version", F.struct("ts", "event_id"))
    handle = jobs.upsert_by_day(f"{folder}/rows", ["author_id", "kind", "day"], ["score", "version", "ts", "event_id"], "version")
    jobs.start(seen, handle, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("author_id", "kind", "score", "day")


@query("n07_claim_stream", with_tables("vec", "RECURSIVE " + DEDUP_SQL + """
SELECT claim_id, is_canonical, canonical_claim, round(similarity, 6) AS similarity FROM outcome"""))
def n07(spark, d):
    """The second half of the claim vectors arrives as a stream against the first half."""
    folder = _work_folder(spark)
    is_new = F.col("vec_id") % 2 == 1
    schema = B.read_table(spark, d, "embeddings").schema
    arriving = B.claim_columns(spark.readStream.schema(schema).parquet(f"{d}/embeddings*.parquet").where(is_new))
    known = B.claim_vectors(spark, d).where(F.col("claim_id") % 2 == 0).withColumn("is_canonical", F.lit(True))
    store = ClaimStore(f"{folder}/store").create(known)
    handle = jobs.process_claims(store, folder, duplicate=0.40, related=0.30, near=0.30, contradict=0.10)
    jobs.start(arriving, handle, f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/outcome")
    return found.select("claim_id", "is_canonical", "canonical_claim", F.round("similarity", 6).alias("similarity"))
