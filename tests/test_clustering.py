"""Clusterings against naive models."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import vectors

from colloquy.operators import clustering as H
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan

PLANS = [DEFAULT_PLAN, BlockPlan(block_rows=12, cell_rows=12)]


def claims(spark, rows):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "claim_id long, embedding array<double>").repartition(4)


def groups(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    return {frozenset(g) for c, g in found.items() if c is not None}


def naive_linkage(rows, t, kind):
    dots = rows @ rows.T
    clusters = [[i] for i in range(len(rows))]
    while len(clusters) > 1:
        best = (-2, None)
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                block = dots[np.ix_(clusters[a], clusters[b])]
                s = {"single": block.max(), "complete": block.min(), "average": block.mean()}[kind]
                if s > best[0]:
                    best = (s, (a, b))
        if best[0] < t:
            break
        a, b = best[1]
        clusters[a] += clusters.pop(b)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("kind,run", [("single", H.single_linkage), ("average", H.average_linkage), ("complete", H.complete_linkage)])
def test_linkage(spark, plan, kind, run):
    rows = vectors(7, n=30)
    assert groups(run(claims(spark, rows), 0.8, plan)) == naive_linkage(rows, 0.8, kind)


@pytest.mark.parametrize("plan, threshold", [
    (BlockPlan(block_rows=4, cell_rows=10**6), 0.2), (BlockPlan(block_rows=10, cell_rows=9, pivots=3), 0.9),
])
def test_linkage_of_clusters_beyond_a_block(spark, plan, threshold):
    """Clusters that must be cut into pieces; named by strings, as claims may be."""
    rows = vectors(17, n=40, hot=True)
    df = claims(spark, rows).withColumn("claim_id", F.concat(F.lit("c"), F.col("claim_id") + 100))
    for run, kind in ((H.complete_linkage, "complete"), (H.average_linkage, "average")):
        found = {frozenset(int(i[1:]) - 100 for i in g) for g in groups(run(df, threshold, plan))}
        distinct = {frozenset(g) for g in naive_linkage(rows, threshold, kind)}
        assert found == distinct


def test_complete_linkage_of_a_dense_group_is_linear(spark):
    """5,000 points that are all similar: 12.5 million pairs, of which blocks hand on at most three per point."""
    rng = np.random.default_rng(2)
    rows = np.ones((5000, 6)) + rng.normal(scale=0.05, size=(5000, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    df = claims(spark, rows)
    points = df.select(F.col("claim_id").alias("id"), F.col("embedding").alias("vec"), F.col("claim_id").alias("cluster"))
    assert H.complete_candidates(points, None, 0.9).count() <= 3 * 5000
    found = H.complete_linkage(df.where("claim_id < 800"), 0.98).collect()
    members = {}
    for r in found:
        members.setdefault(r["cluster"], []).append(r["id"])
    assert sum(map(len, members.values())) == 800 and len(members) < 200
    for name, ids in members.items():
        assert name == min(ids) and (rows[ids] @ rows[ids].T).min() >= 0.98 - 1e-12


@pytest.mark.parametrize("kind,run,asks", [("average", H.average_linkage, "top_matches"), ("complete", H.complete_linkage, "complete_candidates")])
def test_the_last_merges_of_linkage_are_made_by_one_task(spark, monkeypatch, kind, run, asks):
    """Points whose clusters merge a pair at a time: the partners are asked for once, not in a round per merge."""
    angles = np.cumsum(1.0 / np.arange(3, 12))
    rows = np.vstack([np.column_stack([np.cos(angles), np.sin(angles), 0 * angles]), vectors(3, n=9, dim=3)])
    df, expected, calls, ask = claims(spark, rows), naive_linkage(rows, 0.5, kind), [], getattr(H, asks)
    monkeypatch.setattr(H, asks, lambda *args, **named: calls.append(1) or ask(*args, **named))
    assert groups(run(df, 0.5)) == expected and len(calls) == 1
    # Rounds of jobs, down to a few clusters, find the same.
    monkeypatch.setattr(H, "SETTLED_ROWS", 6)
    assert groups(run(df, 0.5, BlockPlan(block_rows=12, cell_rows=10**6))) == expected and len(calls) > 2


def test_linkage_of_claims_that_come_twice(spark):
    rows = vectors(7, n=30)
    df = claims(spark, rows)
    for run in (H.average_linkage, H.complete_linkage):
        found = [(r["id"], r["cluster"]) for r in run(df.unionByName(df.where("claim_id < 12")), 0.8).collect()]
        assert sorted(i for i, _ in found) == sorted([*range(30), *range(12)]) and len(set(found)) == 30


@pytest.mark.parametrize("plan", PLANS)
def test_dbscan(spark, plan):
    rows = np.vstack([vectors(8, n=60), np.tile(vectors(9, n=1), (6, 1))])
    sims = rows @ rows.T >= 0.9
    np.fill_diagonal(sims, False)
    core = {i for i in range(len(rows)) if sims[i].sum() >= 3}
    label = {}
    for start in sorted(core):
        if start in label:
            continue
        stack, label[start] = [start], start
        while stack:
            for j in np.nonzero(sims[stack.pop()])[0]:
                if j in core and j not in label:
                    label[j] = start
                    stack.append(j)
    expected = dict(label)
    for i in set(range(len(rows))) - core:
        near = [label[j] for j in np.nonzero(sims[i])[0] if j in core]
        expected[i] = min(near) if near else None
    got = {r["id"]: r["cluster"] for r in H.dbscan_clusters(claims(spark, rows), 0.1, 3, plan).collect()}
    assert got == expected


def test_dbscan_all_noise(spark):
    got = H.dbscan_clusters(claims(spark, np.eye(4)), 0.1, 3).collect()
    assert all(r["cluster"] is None for r in got)


def test_kmeans(spark):
    rows = np.array([[1, 0, 0], [0.99, 0.1, 0], [0.98, 0.05, 0], [0, 1, 0], [0.1, 0.99, 0], [0.05, 0.98, 0]])
    assert groups(H.kmeans_clusters(claims(spark, rows), 2)) == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}
    few = H.kmeans_clusters(claims(spark, rows[:2]), 5).collect()
    assert len({r["cluster"] for r in few}) == 2


def test_kmeans_sends_centers_only_and_equals_mllib(spark, monkeypatch):
    rows = vectors(np.random.default_rng(5), 300, 6)
    asked, mllib = [], H.KMeans

    def drawing(**settings):
        asked.append(settings["maxIter"])
        return mllib(**settings)

    monkeypatch.setattr(H, "KMeans", drawing)
    table = claims(spark, rows).orderBy("claim_id").coalesce(1)
    got = {r["id"]: r["cluster"] for r in H.kmeans_clusters(table, 12).collect()}
    # MLlib's own steps collect the distances of all pairs of centers.
    assert asked == [0]
    ready = H.materialize(H._ready(table)).withColumn("features", H.array_to_vector("vec"))
    model = mllib(k=12, maxIter=100, seed=42, distanceMeasure="cosine").fit(ready)
    assert got == {r["id"]: str(r["prediction"]) for r in model.transform(ready).collect()}


def test_kmeans_leaves_zero_vectors_and_keeps_empty_centers(spark):
    rows = np.array([[1.0, 0, 0], [0, 0, 0], [0, 1, 0], [1, 0, 0]])
    got = {r["id"]: r["cluster"] for r in H.kmeans_clusters(claims(spark, rows), 2).collect()}
    assert got[1] is None and got[0] == got[3] != got[2] and got[2] is not None
    centers = np.array([[1.0, 0], [0, 1], [-1, 0]])
    points = claims(spark, np.array([[1.0, 0], [0.6, 0.8], [0.8, 0.6], [0.0, -1]])).selectExpr("claim_id id", "embedding vec")
    moved = H._moved_centers(points, centers)
    assert np.allclose(moved, [[1.8 / np.hypot(1.8, 0.4), -0.4 / np.hypot(1.8, 0.4)], [0.6, 0.8], [-1, 0]])


def test_silhouette_of_coincident_points_and_single_cluster(spark):
    rows = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]])
    clusters = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "id long, cluster string")
    assert H.silhouette(claims(spark, rows), clusters).head()["silhouette"] == pytest.approx(1.0)
    one = spark.createDataFrame([(i, "a") for i in range(4)], "id long, cluster string")
    assert H.silhouette(claims(spark, rows), one).head()["silhouette"] == 0


def test_zero_vectors_stay_alone(spark):
    rows = [[0.0, 0.0]] * 4 + [[1.0, 0.0]] * 3 + [[0.0, 1.0]]
    claims = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "claim_id long, embedding array<double>")
    for clusters in (H.single_linkage(claims, 0.5), H.average_linkage(claims, 0.5), H.complete_linkage(claims, 0.5)):
        assert {r["id"]: r["cluster"] for r in clusters.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7}
    found = {r["id"]: r["cluster"] for r in H.dbscan_clusters(claims, 0.3, 2).collect()}
    assert found == {0: None, 1: None, 2: None, 3: None, 4: 4, 5: 4, 6: 4, 7: None}


def test_average_linkage_does_not_depend_on_block_size(spark):
    import numpy as np

    from colloquy.operators.similarity import BlockPlan

    rows = np.random.default_rng(3).normal(size=(60, 4))
    claims = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "claim_id long, embedding array<double>")
    a, b = (sorted(map(tuple, H.average_linkage(claims, 0.6, plan).collect())) for plan in (BlockPlan(12, 10**6), BlockPlan()))
    assert a == b


def test_silhouette_of_opposite_points(spark):
    x = [0.1 * k for k in (3, 7, 1, 9)]
    rows = [(0, x), (1, x), (2, [-v for v in x])]
    claims = spark.createDataFrame(rows, "claim_id long, embedding array<double>")
    clusters = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id long, cluster string")
    row = H.silhouette(claims, clusters).head()
    assert row["points"] == 2 and abs(row["silhouette"] - 1) < 1e-9
