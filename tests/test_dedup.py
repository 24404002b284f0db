"""Incremental deduplication against one-by-one processing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import vectors

from colloquy.operators import dedup as D
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan

PLANS = [DEFAULT_PLAN, BlockPlan(block_rows=8, cell_rows=25)]


def sequential(order, rows, known, dup, rel, limit=10):
    canon, outcome = list(known), {}
    for i in order:
        sims = [(rows[i] @ rows[c], c) for c in canon]
        near = sorted([s for s in sims if s[0] >= dup], key=lambda s: (-round(s[0], 12), canon.index(s[1])))
        if near:
            outcome[i] = (False, near[0][1], None)
        else:
            related = sorted([(s, c) for s, c in sims if rel <= s < dup], key=lambda s: -s[0])[:limit]
            outcome[i] = (True, None, {c for _, c in related})
            canon.append(i)
    return outcome


def claims(spark, rows, ids, order_of):
    data = [(i, [float(x) for x in rows[i]], int(order_of[i]), 0.5 + i / 1000, True) for i in ids]
    df = spark.createDataFrame(data, "claim_id long, embedding array<double>, o long, confidence double, is_canonical boolean")
    return df.withColumn("extracted_at", F.timestamp_seconds("o"))


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_sequential(spark, plan, seed):
    rows = vectors(seed, n=90, hot=seed == 1)
    rng = np.random.default_rng(seed + 10)
    known = [i for i in range(90) if i % 9 == 4]
    known = [c for n, c in enumerate(known) if not any(rows[c] @ rows[k] >= 0.92 for k in known[:n])]
    ids = [i for i in range(90) if i not in known]
    order_of = {i: int(p) for i, p in zip(range(90), rng.permutation(90))}
    outcome = D.deduplicate_claims(claims(spark, rows, ids, order_of), claims(spark, rows, known, order_of), 0.92, 0.75, plan=plan)
    got = {r["claim_id"]: r for r in outcome.collect()}
    expected = sequential(sorted(ids, key=lambda i: order_of[i]), rows, known, 0.92, 0.75)
    assert {i: r["is_canonical"] for i, r in got.items()} == {i: e[0] for i, e in expected.items()}
    for i, (canonical, target, related) in expected.items():
        if canonical:
            assert {r["claim_id"] for r in got[i]["related"] or []} == related
        else:
            # Equal vectors tie; what must agree is the similarity of the link.
            assert rows[i] @ rows[got[i]["canonical_claim"]] == pytest.approx(rows[i] @ rows[target], abs=1e-9)


def chain(n, step=0.3, dim=4):
    """Each row is similar to its neighbours in order and to no others; it turns in planes one after the other."""
    angles = np.arange(n) * step
    radius = np.sqrt(0.5)
    return np.stack([radius * np.cos(angles), radius * np.sin(angles), radius * np.cos(angles / 97), radius * np.sin(angles / 97)], axis=1)


def greedy(rows, threshold):
    leaders, flags = [], []
    for row in rows:
        flags.append(not leaders or (rows[leaders] @ row).max() < threshold)
        if flags[-1]:
            leaders.append(len(flags) - 1)
    return flags


@pytest.mark.parametrize("group_rows", [D.GROUP_ROWS, 400])
def test_long_chains_need_few_rounds(spark, monkeypatch, group_rows):
    n, threshold = 5000, 0.95
    rows = chain(n)
    df = spark.createDataFrame(
        [(i, [float(x) for x in r], f"{i:08d}") for i, r in enumerate(rows)], "id long, vec array<double>, ord string"
    )
    rounds, real = [], D.spanning_edges
    monkeypatch.setattr(D, "spanning_edges", lambda *a: rounds.append(1) or real(*a))
    found = {r["id"]: r["is_leader"] for r in D.choose_canonical(df, threshold, group_rows=group_rows).collect()}
    assert [found[i] for i in range(n)] == greedy(rows, threshold)
    assert sum(found.values()) < n and len(rounds) <= 30
    if group_rows == D.GROUP_ROWS:
        assert len(rounds) == 1


def test_groups_beyond_the_limit_are_settled_in_order(spark):
    rows = vectors(5, n=150, hot=True)
    df = spark.createDataFrame(
        [(i, [float(x) for x in r], f"{i:08d}") for i, r in enumerate(rows)], "id long, vec array<double>, ord string"
    )
    for group_rows in (2, 10):
        for threshold in (0.6, 0.9):
            found = {r["id"]: r["is_leader"] for r in D.choose_canonical(df, threshold, PLANS[1], group_rows).collect()}
            assert [found[i] for i in range(150)] == greedy(rows, threshold)


def test_confidence_is_raised(spark):
    rows = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    new = claims(spark, rows, [1, 2], {1: 1, 2: 2})
    known = claims(spark, rows, [0], {0: 0})
    outcome = D.deduplicate_claims(new, known)
    raised = {r["claim_id"]: r["confidence"] for r in D.canonical_confidence(known, new, outcome).collect()}
    assert raised[0] == pytest.approx(0.501)


def test_merge_moves_and_conflicts(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "claim_id long, embedding array<double>")
    stances = spark.createDataFrame(
        [(0, "agrees", "a"), (1, "disagrees", "b"), (2, None, None), (3, "neutral", "c"), (5, None, "d")],
        "claim_id long, user_stance string, user_note string",
    )
    merges = spark.createDataFrame([(1, 0), (3, 2), (5, 4)], "dup_id long, canon_id long")
    edges, table, report = D.merge_duplicates(merges, v, stances)
    told = {r["dup_id"]: (r["stances_moved"], r["stance_conflicts"]) for r in report.collect()}
    assert told == {1: (0, 1), 3: (1, 0), 5: (1, 0)}
    rows = {r["claim_id"]: (r["user_stance"], r["user_note"]) for r in table.collect()}
    assert rows == {0: ("agrees", "a"), 1: ("disagrees", "b"), 2: ("neutral", "c"), 4: (None, "d")}
    assert edges.count() == 3
