"""Block joins against brute force: several cells and blocks, skew, copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colloquy.operators import similarity as S
from colloquy.operators.graph import connected_components

#: One cell, cells of one level, and cells of two levels.
PLANS = [S.DEFAULT_PLAN, S.BlockPlan(block_rows=16, cell_rows=20), S.BlockPlan(block_rows=16, cell_rows=8, pivots=4)]


def vectors(seed=0, n=160, dim=8, hot=False):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    rows = centers[rng.integers(0, 6, n)] + rng.normal(scale=0.35, size=(n, dim))
    if hot:
        # A third of all rows: half of them equal, half nearly equal.
        rows[: n // 6] = rows[0]
        rows[n // 6 : n // 3] = rows[0] + rng.normal(scale=0.01, size=(n // 3 - n // 6, dim))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, rows, parts=5):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "id long, vec array<double>").repartition(parts)


def brute_pairs(rows, t):
    dots = rows @ rows.T
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if dots[i, j] >= t}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("t", [0.95, 0.7, 0.2])
def test_pairs_equal_brute_force(spark, plan, t):
    rows = vectors()
    found = S.similar_pairs(frame(spark, rows), t, plan).collect()
    pairs = [(r["id_a"], r["id_b"]) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute_pairs(rows, t)


@pytest.mark.parametrize("plan", PLANS)
def test_hot_group_is_whole(spark, plan):
    rows = vectors(1, hot=True)
    found = S.similar_pairs(frame(spark, rows), 0.9, plan).collect()
    assert {(r["id_a"], r["id_b"]) for r in found} == brute_pairs(rows, 0.9)


@pytest.mark.parametrize("plan", PLANS)
def test_top_matches(spark, plan):
    rows = vectors(2)
    queries = frame(spark, rows).withColumn("exclude", F.array("id"))
    corpus = frame(spark, rows).withColumn("tags", F.array("id"))
    found = S.top_matches(queries, corpus, 4, 0.5, plan).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["match_id"])
    dots = rows @ rows.T
    for i in range(len(rows)):
        order = sorted((j for j in range(len(rows)) if j != i and dots[i, j] >= 0.5), key=lambda j: (-dots[i, j], j))
        assert got.get(i, []) == order[:4]


@pytest.mark.parametrize("plan", PLANS)
def test_neighbour_counts_and_components(spark, plan):
    rows = vectors(3)
    df = frame(spark, rows)
    counts = {r["id"]: r["neighbours"] for r in S.neighbour_counts(df, 0.85, plan).collect()}
    dots = rows @ rows.T
    for i in range(len(rows)):
        assert counts.get(i, 0) == (dots[i] >= 0.85).sum() - 1
    edges = S.spanning_edges(df, 0.85, plan)
    labels = {r["id"]: r["component"] for r in connected_components(df, edges).collect()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in brute_pairs(rows, 0.85):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    assert labels == {i: find(i) for i in range(len(rows))}


def test_spanning_edges_stay_linear(spark):
    """A dense group of n rows must not yield n * n edges."""
    rows = np.tile(vectors(4, n=1), (120, 1)) + np.random.default_rng(0).normal(scale=1e-3, size=(120, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    plan = S.BlockPlan(block_rows=32, cell_rows=10**6)
    blocks = 4 * 4
    assert S.spanning_edges(frame(spark, rows), 0.9, plan).count() <= 2 * 32 * blocks


def test_copies_are_folded(spark):
    rows = np.vstack([vectors(5, n=10), np.tile(vectors(6, n=1), (20, 1))])
    found = {(r["id_a"], r["id_b"]): r["similarity"] for r in S.duplicate_pairs(frame(spark, rows), 0.99).collect()}
    star = {(10, i) for i in range(11, 30)}
    assert star <= set(found)
    assert len([p for p in found if p[0] >= 10]) == len(star)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300)
    edges = spark.range(299).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    assert connected_components(nodes, edges).select("component").distinct().count() == 1


def test_copies_expand_to_all_pairs(spark):
    """Copies, a hot group of copies and zero vectors: the folded result stands for every similar pair."""
    base = vectors(7, n=12)
    rows = np.vstack([base, base[:4], np.tile(base[5], (9, 1)), np.zeros((3, base.shape[1]))])
    dots = rows @ rows.T
    for plan in PLANS:
        pairs = S.duplicate_pairs(frame(spark, rows), 0.6, plan)
        got = {(r["id_a"], r["id_b"]) for r in S.expand_pairs(pairs).collect()}
        expected = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if dots[i, j] >= 0.6 - 1e-12}
        assert got == expected
        assert pairs.where("kind = 'copy'").count() == 4 + 9


def test_pairs_of_copies_are_rows_of_their_own(spark):
    """Every row of a hot group of copies pairs with each other one and with all that is similar to it."""
    base = vectors(7, n=12)
    rows = np.vstack([base, base[:4], np.tile(base[5], (9, 1)), np.zeros((3, base.shape[1]))])
    dots = rows @ rows.T
    expected = sorted((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if dots[i, j] >= 0.6 - 1e-12)
    for plan in PLANS:
        found = S.duplicate_pairs(frame(spark, rows), 0.6, plan, folded=False).collect()
        assert sorted((r["id_a"], r["id_b"]) for r in found) == expected
        assert {r["kind"] for r in found} == {"similar"}
        assert all(abs(r["similarity"] - dots[r["id_a"], r["id_b"]]) < 1e-9 for r in found)


def test_g02_pairs_equal_claims_too(spark, tmp_path):
    v = [0.6, 0.8, 0.0]
    rows = [(0, v, 1), (1, v, 1), (2, [0.8, 0.6, 0.0], 1), (3, v, 1), (3, v, 1), (4, [0.0, 0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = entry.queries()["g02_similar_pairs"](spark, str(tmp_path)).collect()
    pairs = sorted((r["id_a"], r["id_b"], r["similarity"], r["kind"]) for r in found)
    near = [(a, b, 1.0 if 2 not in (a, b) else 0.96, "similar") for a, b in [(0, 1), (0, 2), (0, 3), (0, 3), (1, 2), (1, 3), (1, 3), (2, 3), (2, 3)]]
    assert pairs == near


def clustered(clusters, each, dim=24, seed=9):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    rows = np.repeat(centers, each, axis=0) + rng.normal(scale=0.12, size=(clusters * each, dim))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("plan", [S.BlockPlan(cell_rows=40), S.BlockPlan(cell_rows=10, pivots=40)])
def test_few_cells_are_visited_for_the_best(spark, plan):
    """At the thresholds in use, a row's own k-th match rules out nearly all cells of clustered vectors."""
    rows = clustered(40, 50)
    df = frame(spark, rows)
    index = S.cell_index(df, plan)
    assert (index.inner is not None) == (plan.pivots == 40)
    cells = index.rows.select("home").distinct().count()
    placed = index.place(df.withColumn("least", F.lit(0.5)))
    first = S.top_matches(df, df, 5, 0.5, plan).select("query_id", "match_id", "similarity")
    visited = index.visits(S.narrowed(placed, first, 5)).where("cell <> home").count()
    assert visited < 0.1 * len(rows) * cells
    fixed = index.visits(df.withColumn("radius", F.lit(S._radius(0.5)))).count()
    assert visited < fixed


def test_second_level_splits_crowded_cells(spark):
    rows = clustered(12, 40, dim=8)
    index = S.cell_index(frame(spark, rows), S.BlockPlan(cell_rows=10, pivots=8))
    sizes = [r["count"] for r in index.rows.groupBy("home").count().collect()]
    assert len(index.top) == 8 and len(sizes) > 24 and sum(sizes) == len(rows)


def test_pivots_lie_apart():
    rows = clustered(30, 20)
    points = S.spread_pivots(rows, 30)
    nearest = (points @ rows.T).argmax(axis=1) // 20
    assert len(points) == 30 and len(set(nearest)) >= 25
    assert len(S.spread_pivots(np.tile(rows[:1], (50, 1)), 9)) == 1


@pytest.mark.parametrize("plan", PLANS)
def test_listed_pairs_do_not_count(spark, plan):
    """A third of all pairs excluded, most of them of one row on either side."""
    rows = vectors(12, n=60)
    listed = {(0, j) for j in range(0, 60, 2)} | {(i, 7) for i in range(0, 60, 3)} | {(i, i) for i in range(60)} | {(99, 1), (1, 99)}
    excluded = spark.createDataFrame(sorted(listed) * 2, "query_id long, match_id long")
    df = frame(spark, rows)
    found = S.top_matches(df, df, 4, 0.1, plan, excluded).collect()
    dots = rows @ rows.T
    for i in range(60):
        order = sorted((j for j in range(60) if (i, j) not in listed and dots[i, j] >= 0.1), key=lambda j: (-dots[i, j], j))
        assert [r["match_id"] for r in sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])] == order[:4]


def test_exclusions_by_tags(spark):
    rows = vectors(8, n=20)
    df = frame(spark, rows)
    asked = df.withColumn("exclude", F.array("id", F.lit(3)))
    told = df.withColumn("tags", F.array("id"))
    found = S.top_matches(asked, told, 30, -2.0).select("query_id", "match_id").collect()
    assert all(r["match_id"] not in (r["query_id"], 3) for r in found)
    assert len(found) == sum(len({0, *range(20)} - {i, 3}) for i in range(20))


def test_chunks_do_not_grow_in_number_with_the_rows(spark):
    plan = S.BlockPlan(block_rows=4)
    most = S.PAIRS_PER_CORE * spark.sparkContext.defaultParallelism
    for n in (1000, 4000):
        side = spark.range(n).select("id", F.lit(0).alias("cell"), F.array(F.lit(1.0)).alias("vec"))
        size = S.chunk_sizes(side, side.select("*"), plan, True).collect()[0]
        assert size["l_blocks"] == n // 4 and size["l_chunks"] * size["r_chunks"] <= most
    # A chunk holds no more rows than a task may.
    size = S.chunk_sizes(side, side.select("*"), S.BlockPlan(block_rows=4, chunk_rows=40), True).collect()[0]
    assert size["l_chunks"] == size["r_chunks"] == 100


@pytest.mark.parametrize("plan", [S.BlockPlan(block_rows=8, result_rows=5), S.BlockPlan(block_rows=8, cell_rows=40, result_rows=5)])
def test_pairs_of_blocks_left_to_later_tasks_are_whole(spark, plan):
    rows = vectors(3, hot=True)
    found = [(r["id_a"], r["id_b"]) for r in S.similar_pairs(frame(spark, rows), 0.6, plan).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(rows, 0.6)
