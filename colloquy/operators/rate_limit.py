"""Audit of a sliding request limit: which requests a limiter would have admitted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.ordered import first_rows

MAX_REQUESTS = 30
WINDOW_MS = 60_000


def admit(recent: deque, at_ms: int, limit: int, window_ms: int) -> bool:
    """Admits a request unless `limit` admitted ones lie within the window; refused ones do not count."""
    while recent and at_ms - recent[0] >= window_ms:
        recent.popleft()
    if len(recent) >= limit:
        return False
    recent.append(at_ms)
    return True


def rate_limit_audit(
    requests: DataFrame, limit: int = MAX_REQUESTS, window_ms: int = WINDOW_MS, admitted_before: DataFrame | None = None
) -> DataFrame:
    """Adds `admitted` to (client, request_id, at_ms).

    A whole window without requests empties the limiter, so runs of consecutive busy windows are
    independent and are spread over tasks. Rows stream through a task in time order with at most
    `limit` timestamps of state; nothing is held per client. `admitted_before` (client, at_ms) are
    admissions of earlier audits; they count in their windows and are not reported.
    """
    rows = requests.select("client", "request_id", "at_ms", F.lit(True).alias("asked"))
    if admitted_before is not None:
        rows = rows.unionByName(
            admitted_before.select("client", F.lit(0).cast("long").alias("request_id"), "at_ms", F.lit(False).alias("asked"))
        )
    rows = rows.withColumn("_slot", F.floor(F.col("at_ms") / window_ms))
    # One row per client and busy window; consecutive slots share slot - row number.
    slots = rows.select("client", "_slot").distinct().withColumn(
        "_run", F.col("_slot") - F.row_number().over(Window.partitionBy("client").orderBy("_slot"))
    )
    ordered = (
        rows.join(slots, ["client", "_slot"]).repartition("client", "_run")
        .sortWithinPartitions("client", "_run", "at_ms", "asked", "request_id")
        .select("client", "request_id", "at_ms", "_run", "asked")
    )

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = None, deque()
        for batch in batches:
            flags = []
            for client, at_ms, run, asked in zip(batch["client"], batch["at_ms"], batch["_run"], batch["asked"]):
                if (client, run) != key:
                    key, recent = (client, run), deque()
                if asked:
                    flags.append(admit(recent, at_ms, limit, window_ms))
                else:
                    recent.append(at_ms)
            yield batch.loc[batch["asked"], ["client", "request_id", "at_ms"]].assign(admitted=flags)

    kind = requests.schema["client"].dataType.simpleString()
    return ordered.mapInPandas(audit, schema=f"client {kind}, request_id bigint, at_ms bigint, admitted boolean")


def last_admissions(admitted: DataFrame, limit: int = MAX_REQUESTS) -> DataFrame:
    """The latest `limit` admissions of each client, as one row: (client, stamps)."""
    latest = first_rows(admitted.select("client", "at_ms"), ["client"], [F.desc("at_ms")], limit, "place")
    return latest.groupBy("client").agg(F.sort_array(F.collect_list("at_ms")).alias("stamps"))
