"""Streams agree with their batch twins and continue over several runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import clustered, vectors

from colloquy.operators.claim_store import ClaimStore
from colloquy.operators.dedup import deduplicate_claims
from colloquy.operators.rate_limit import rate_limit_audit
from colloquy.operators.similarity import BlockPlan
from colloquy.plans import bindings as B
from colloquy.plans.registry import QUERIES
from colloquy.streaming import jobs

import __spark_entry__  # noqa: F401  registers the queries


def test_rate_limit_stream_equals_batch(spark, base):
    stream = {r["request_id"]: r["admitted"] for r in QUERIES["n05_rate_audit_stream"](spark, base).collect()}
    batch = {r["request_id"]: r["admitted"] for r in rate_limit_audit(B.requests(spark, base)).collect()}
    assert stream == batch


def _stream(spark, folder, df, handle, rounds):
    """Feeds the parts of a frame (column `part`) one after the other through a stream."""
    for part in range(rounds):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.drop("part").schema).parquet(f"{folder}/in")
        jobs.start(stream, handle, f"{folder}/state").awaitTermination()


@pytest.mark.parametrize("rounds", [1, 5])
def test_rate_limit_over_batches_equals_one_pass(spark, tmp_path, rounds):
    """One client sends a third of all requests; batches follow time, rows within a batch are shuffled."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 == 0 else f"c{i % 17}", i, int(i * 400 + rng.integers(0, 300))) for i in range(1500)]
    df = spark.createDataFrame(rows, "client string, request_id long, at_ms long").withColumn(
        "part", F.floor(F.col("request_id") * rounds / 1500)
    ).orderBy(F.rand(1))
    whole = {r["request_id"]: r["admitted"] for r in rate_limit_audit(df.drop("part")).collect()}
    _stream(spark, str(tmp_path), df, jobs.audit_requests(str(tmp_path / "out")), rounds)
    found = {r["request_id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out/audit")).collect()}
    assert found == whole and 0 < sum(whole.values()) < 1500


def test_a_repeated_batch_is_audited_alike(spark, tmp_path):
    df = spark.createDataFrame([("a", i, i * 1000) for i in range(90)], "client string, request_id long, at_ms long")
    handle = jobs.audit_requests(str(tmp_path))
    first, second = df.where("request_id < 45"), df.where("request_id >= 45")
    handle(first, 0)
    handle(second, 1)
    once = sorted(map(tuple, spark.read.parquet(str(tmp_path / "audit")).collect()))
    handle(second, 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "audit")).collect())) == once
    whole = {r["request_id"]: r["admitted"] for r in rate_limit_audit(df).collect()}
    assert {r[1]: r[3] for r in once} == whole


def _claims(spark, rows):
    names = ["supports", "opposes", "has", "lacks"]
    data = [(i, f"s{i % 3}", names[i % 4], f"o{i % 2}", [float(x) for x in r], 0.9, True, i) for i, r in enumerate(rows)]
    schema = "claim_id long, subject string, predicate string, object string, embedding array<double>, confidence double, is_canonical boolean, at long"
    return spark.createDataFrame(data, schema).withColumn("extracted_at", F.timestamp_seconds("at")).drop("at")


@pytest.mark.parametrize("rounds", [1, 5])
def test_claim_batches_equal_one_pass(spark, tmp_path, rounds):
    rows = vectors(21, n=200)
    claims = _claims(spark, rows)
    plan = BlockPlan(block_rows=32, cell_rows=20)
    store = ClaimStore(str(tmp_path / "store"), plan).create(claims.where("claim_id < 100"))
    arriving = claims.where("claim_id >= 100").withColumn("part", F.floor((F.col("claim_id") - 100) * rounds / 100)).orderBy(F.rand(2))
    _stream(spark, str(tmp_path), arriving, jobs.process_claims(store, str(tmp_path / "out")), rounds)
    found = {r["claim_id"]: r for r in spark.read.parquet(str(tmp_path / "out/outcome")).collect()}
    whole = deduplicate_claims(claims.where("claim_id >= 100"), claims.where("claim_id < 100")).collect()
    assert {i: (r["is_canonical"], r["canonical_claim"]) for i, r in found.items()} == {
        r["claim_id"]: (r["is_canonical"], r["canonical_claim"]) for r in whole
    }
    canonical = {r["claim_id"] for r in whole if r["is_canonical"]}
    assert {r["claim_id"] for r in store.read(spark).collect()} == {*range(100), *canonical}


def test_a_batch_reads_the_cells_it_can_reach(spark, tmp_path):
    rows = clustered(30, 20)
    claims = _claims(spark, rows)
    store = ClaimStore(str(tmp_path), BlockPlan(cell_rows=6)).create(claims.where("claim_id % 2 = 0"))
    store.append(claims.where("claim_id % 4 = 1"), 1)
    store.append(claims.where("claim_id % 4 = 3"), 2)
    few = claims.where("claim_id in (3, 4)")
    near = store.near(few, 0.65)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and len(store.cells_near(few, 0.65)) < 15
    read, stored = (df.select(F.input_file_name()).distinct().count() for df in (near, store.read(spark)))
    assert read < 0.35 * stored
    dots = rows @ rows[[3, 4]].T
    reached = {r["claim_id"] for r in near.collect()}
    assert {i for i in range(len(rows)) if dots[i].max() >= 0.65} <= reached and len(reached) < len(rows) / 2
    assert {r["claim_id"] for r in store.near(few, 0.65, before=2).collect()} == {i for i in reached if i % 4 != 3}
    store.append(claims.where("claim_id % 4 = 3"), 2)
    assert store.read(spark).count() == len(rows)
    bare = claims.where("claim_id < 5").withColumn("embedding", F.lit(None).cast("array<double>"))
    store.append(bare.withColumn("claim_id", F.col("claim_id") + 1000), 3)
    assert store.read(spark).count() == len(rows) + 5 and store.near(few, 0.65).count() == len(reached)
    store.rebuild(spark)
    assert store.read(spark).count() == len(rows) + 5
    again = {r["claim_id"] for r in store.near(few, 0.65).collect()}
    assert {i for i in range(len(rows)) if dots[i].max() >= 0.65} <= again


def test_ingest_in_two_runs(spark, tmp_path):
    schema = "comment_id string, score long, at timestamp, day date"

    def arrive(rows):
        df = spark.createDataFrame(rows, "comment_id string, score long, at long").withColumn("at", F.timestamp_seconds("at"))
        df.withColumn("day", F.to_date("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        handle = jobs.upsert_by_day(str(tmp_path / "table"), ["comment_id"], ["score", "at"], "at")
        jobs.start(stream, handle, str(tmp_path / "state")).awaitTermination()
        return {r["comment_id"]: r["score"] for r in spark.read.parquet(str(tmp_path / "table")).collect()}

    assert arrive([("a", 1, 10), ("b", 2, 20), ("a", 5, 30)]) == {"a": 5, "b": 2}
    assert arrive([("a", 9, 40), ("c", 3, 90_000)]) == {"a": 9, "b": 2, "c": 3}
