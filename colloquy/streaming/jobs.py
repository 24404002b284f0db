"""Incremental jobs on Structured Streaming: usage, rate limits, ingest, claim processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.functions.text import cost_usd
from colloquy.operators import contradictions as I
from colloquy.operators.bucket_table import BucketTable
from colloquy.operators.claim_store import ClaimStore
from colloquy.operators.dedup import deduplicate_claims
from colloquy.operators.rate_limit import MAX_REQUESTS, WINDOW_MS, last_admissions, rate_limit_audit
from colloquy.operators.related import related_for_new_claims
from colloquy.operators.upsert import upsert
from colloquy.session import discard, materialize


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over everything available and stops; repeated starts continue where the last one ended."""
    return (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_usage(usage: DataFrame) -> DataFrame:
    """Totals per day of (ts, input_tokens, output_tokens)."""
    return usage.groupBy(F.to_date("ts").alias("run_date")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count(F.lit(1)).alias("requests"),
    )


def write_totals(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the totals of each micro-batch; `read_totals` adds them up.

    However late a row comes, it counts in its day. A repeated batch overwrites its own totals.
    """
    def handle(batch: DataFrame, number: int) -> None:
        daily_usage(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "requests")]
    totals = spark.read.parquet(path).groupBy("run_date").agg(*sums)
    return totals.withColumn("cost_usd", cost_usd("input_tokens", "output_tokens"))


def audit_requests(path: str, limit: int = MAX_REQUESTS, window_ms: int = WINDOW_MS) -> Callable[[DataFrame, int], None]:
    """Per micro-batch of (client, request_id, at_ms): which requests the limiter admits, under `path`/audit.

    The latest admissions of each client, `limit` at most, are kept in a table by buckets of clients; a
    batch reads and writes the buckets of its clients. Rows pass through the tasks in time order, so a
    client with a third of all requests needs no more memory than any other. A request that comes in a
    later batch than its time is judged by the admissions of its window that are still kept. A repeated
    batch replaces its own results.
    """
    state = BucketTable(f"{path}/admissions", ["client"])

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        requests = materialize(batch.select("client", "request_id", "at_ms"))
        kept = spark.createDataFrame([], f"client {dict(requests.dtypes)['client']}, stamps array<long>")
        clients = requests.select("client").distinct()

        def judged(stamps: DataFrame, _: DataFrame) -> DataFrame:
            earlier = stamps.join(clients, "client", "left_semi").select("client", F.explode("stamps").alias("at_ms"))
            audited = rate_limit_audit(requests, limit, window_ms, earlier)
            audited.write.mode("overwrite").parquet(f"{path}/audit/batch={number}")
            audited = spark.read.schema(audited.schema).parquet(f"{path}/audit/batch={number}")
            now = last_admissions(earlier.unionByName(audited.where("admitted").select("client", "at_ms")), limit)
            return stamps.join(clients, "client", "left_anti").unionByName(now)

        state.merge(clients, judged, number + 1, like=kept)
        discard(requests)

    return handle


def upsert_by_day(path: str, key: list[str], update: list[str], order: str, day: str = "day") -> Callable[[DataFrame, int], None]:
    """Upserts each micro-batch into a table partitioned by day, rewriting only the days it touches.

    A row keeps its day, so its earlier version lies in the same partition. Repeating a batch after
    a failure gives the same table, and so does a repeated or late row: the newest version stays.
    """
    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch)
        existing = read_or_none(spark, path)
        if existing is None:
            existing = batch.where(F.lit(False))
        touched = existing.join(batch.select(day).distinct(), day, "left_semi").select(*batch.columns)
        merged = upsert(touched, batch, key, update, order)
        materialize(merged.select(*batch.columns)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(day).parquet(path)

    return handle


def process_claims(
    store: ClaimStore, path: str, duplicate: float = 0.92, related: float = 0.75, near: float = 0.65, contradict: float = 0.7,
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch of embedded claims: dedup outcome, related claims and contradictions.

    What a batch finds canonical is appended to the store and known to later ones. Of the store only the
    cells are read that the batch can reach at the least of the similarities, so the work follows the
    batch, not the store. Duplicates and related claims are looked for in the store and, in order, in the
    batch; related claims of the batch's claims are claims of the store; contradictions are those with
    the store or within the batch. Outputs go to one folder per batch number, so a repeated batch overwrites
    its own results.
    """
    def handle(batch: DataFrame, number: int) -> None:
        claims = materialize(batch)
        reach = min(duplicate, related, near, contradict)
        known = materialize(store.near(claims, reach, before=number + 1))
        outcome = materialize(deduplicate_claims(claims, known, duplicate, related))
        outcome.write.mode("overwrite").parquet(f"{path}/outcome/batch={number}")
        canonical = claims.join(outcome.where("is_canonical").select("claim_id"), "claim_id", "left_semi")
        store.append(canonical.withColumn("is_canonical", F.lit(True)).select(*known.columns), number + 1)
        related_for_new_claims(claims, known, 2, near).write.mode("overwrite").parquet(f"{path}/related/batch={number}")
        every = known.unionByName(claims.select(*known.columns))
        found = I.contradictions_of(every, claims, contradict)
        found.write.mode("overwrite").parquet(f"{path}/contradictions/batch={number}")
        discard(claims, known, outcome)

    return handle
