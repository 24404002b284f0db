"""Tables merged by bucket, hooks with their stores, search by text."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import bucket_table as BT
from colloquy.operators import clustering as H
from colloquy.operators import contradictions as I
from colloquy.operators import text_search as TS
from colloquy.operators import upsert as U
from colloquy.operators.bucket_table import BUCKET, BucketTable
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan
from colloquy.session import materialize


def _files(path):
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


def _posts(spark, rows):
    return spark.createDataFrame(rows, "post_id string, title string, score long, fetched_at long")


def test_a_merge_leaves_other_buckets_as_they_are(spark, tmp_path):
    table = BucketTable(str(tmp_path), ["post_id"], 8)
    assert table.read(spark) is None
    rows = [(f"p{i}", f"t{i}", i, 1) for i in range(100)]
    assert U.merge_posts(table, _posts(spark, rows)) == 1
    before, held = _files(tmp_path), table.manifest(spark)[1]
    assert set(held.values()) == {1} and len(held) == 8
    assert U.merge_posts(table, _posts(spark, [("p7", "ignored", 70, 2), ("p7", "ignored", 71, 3)])) == 2
    touched = table.bucket_of(_posts(spark, [("p7", "", 0, 0)])).head()[BUCKET]
    now = table.manifest(spark)[1]
    assert {b for b in now if now[b] != held[b]} == {touched}
    after = _files(tmp_path)
    assert all(after[f] == before[f] for f in before) and len({f for f in after if f not in before}) == 1
    expected = {(f"p{i}", f"t{i}", 71 if i == 7 else i, 3 if i == 7 else 1) for i in range(100)}
    assert set(map(tuple, table.read(spark).collect())) == expected
    # A reader of the earlier manifest still sees its own version.
    assert set(map(tuple, table.read(spark, before=2).collect())) == set(rows)


def test_an_unfinished_merge_is_not_seen(spark, tmp_path):
    table = BucketTable(str(tmp_path), ["post_id"], 4)
    U.merge_posts(table, _posts(spark, [("a", "t", 1, 1)]))
    table.bucket_of(_posts(spark, [("b", "t", 1, 1)])).write.partitionBy(BUCKET).parquet(f"{tmp_path}/number=2")
    assert [r["post_id"] for r in table.read(spark).collect()] == ["a"]


def test_numbered_merges_replace_themselves(spark, tmp_path):
    table = BucketTable(str(tmp_path), ["post_id"], 4)
    add = lambda old, new: old.unionByName(new)
    for number in (1, 2, 2):
        table.merge(_posts(spark, [(f"p{number}", "t", number, 1)]), add, number)
    assert sorted(r["post_id"] for r in table.read(spark).collect()) == ["p1", "p2"]


def test_a_bucket_may_lose_its_last_row(spark, tmp_path):
    table = BucketTable(str(tmp_path), ["post_id"], 4)
    rows = _posts(spark, [("a", "t", 1, 1), ("b", "t", 2, 1), ("c", "t", 3, 1)])
    U.merge_posts(table, rows)
    table.merge(rows.where("post_id = 'a'"), lambda old, new: old.join(new.select("post_id"), "post_id", "left_anti"))
    assert sorted(r["post_id"] for r in table.read(spark).collect()) == ["b", "c"]
    table.merge(rows, lambda old, new: old.where("false"))
    assert table.read(spark) is None
    U.merge_posts(table, rows.where("false"))
    assert table.read(spark) is None


def test_verdicts_are_asked_once(spark, tmp_path):
    pairs = [(i, i + 100, f"claim {i}", f"claim {i + 100}") for i in range(20)]
    candidates = spark.createDataFrame(pairs * 2, "claim_id_1 long, claim_id_2 long, claim_1 string, claim_2 string").repartition(2)
    store = BucketTable(str(tmp_path / "v"), ["claim_id_1", "claim_id_2"], 4)
    log = str(tmp_path / "asked")

    def verifier(asked):
        with open(log, "a") as file:
            file.writelines(f"{a}\n" for a, _ in asked)
        if any(a == "claim 3" for a, _ in asked) and len(open(log).readlines()) < 30:
            raise ValueError("busy")
        return [(a.endswith("1"), 0.9, f"{a}+{b}") for a, b in asked]

    first = I.verify_candidates(candidates, store, verifier).collect()
    assert len(first) < 20 and all(r["claim_id_1"] != 3 for r in first)
    second = I.verify_candidates(candidates, store, verifier).collect()
    while len(second) < 20:
        second = I.verify_candidates(candidates, store, verifier).collect()
    lines = open(log).read().split("\n")
    assert all(lines.count(f"claim {r['claim_id_1']}") == 1 for r in first)
    asked = len(lines)
    again = I.verify_candidates(candidates, store, verifier)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, second)) and len(open(log).read().split("\n")) == asked
    assert I.confirmed_by_verdicts(candidates.withColumn("similarity", F.lit(0.8)).distinct(), again).count() == 2


def test_labeler_and_where_it_fails(spark):
    rows = [(i, f"s{i % 3}", "is-better-than", f"o{i}", f"c{i % 4}") for i in range(40)]
    claims = spark.createDataFrame([r[:4] for r in rows], "claim_id long, subject string, predicate string, object string")
    clusters = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(99, None)], "id long, cluster string")

    def labeler(sentences):
        assert len(sentences) == 5
        number = int(sentences[0].rsplit("o", 1)[1])
        if number == 1:
            raise RuntimeError("no answer")
        return None if number == 2 else (sentences[0], sentences[-1], ["k"])

    found = {r["cluster"]: r for r in H.label_clusters(claims, clusters, F.col("claim_id"), labeler, sample=5).collect()}
    default = {r["cluster"]: r for r in H.fallback_labels(claims, clusters, F.col("claim_id")).collect()}
    assert found["c0"]["name"] == "s0 is better than o0" and found["c0"]["description"] == "s1 is better than o16"
    assert found["c1"] == default["c1"] and found["c2"] == default["c2"] and found["c3"]["keywords"] == ["k"]


def _cosine(a, b):
    a, b = (Counter(t.lower().split()) for t in (a or "", b or ""))
    lengths = [math.sqrt(sum(n * n for n in c.values())) for c in (a, b)]
    return round(sum(n * b[w] for w, n in a.items()) / (lengths[0] * lengths[1]), 12) if all(lengths) else 0.0


@pytest.mark.parametrize("plan", [DEFAULT_PLAN, BlockPlan(block_rows=8)])
@pytest.mark.parametrize("threshold, limit", [(0.3, 4), (0.7, 100), (0.05, 3)])
def test_text_search_equals_all_pairs(spark, plan, threshold, limit):
    random_ = random.Random(6)
    words = [f"w{i}" for i in range(30)]

    def text():
        return " ".join(random_.choice(words[: random_.choice([2, 5, 30])]) for _ in range(random_.randrange(1, 12)))

    corpus = [text() for _ in range(80)] + ["the the"] * 30 + [None, "", "  ", "W1  w2"]
    asked = [text() for _ in range(25)] + ["the", "unknown words only", None, "", "the unknown", corpus[3]]
    left = spark.createDataFrame(list(enumerate(corpus)), "id long, text string").repartition(3)
    right = spark.createDataFrame(list(enumerate(asked)), "id long, text string").repartition(3)
    found = {}
    for r in sorted(TS.search_texts(left, right, limit, threshold, plan).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["match_id"], r["similarity"]))
    for i, q in enumerate(asked):
        best = sorted(((j, _cosine(q, t)) for j, t in enumerate(corpus) if _cosine(q, t) >= threshold), key=lambda m: (-m[1], m[0]))
        assert [m[0] for m in found.get(i, [])] == [m[0] for m in best[:limit]]
    with pytest.raises(ValueError):
        TS.search_texts(left, right, 3, 0.0)


def test_texts_of_one_bag_are_searched_once(spark, monkeypatch):
    """600 copies in any order of words, asked for by 40 queries: the join gets a row per prefix word, not per text and query."""
    words = ["go", "rust", "has", "slow", "builds"]
    corpus = [(f"c{i:03}", " ".join(words[i % 5:] + words[: i % 5])) for i in range(600)] + [("d", "go go rust"), (None, "go rust")]
    # The texts of one id are one bag.
    corpus += [("e", "go"), ("e", "rust  GO"), ("f", None)]
    asked = [(i, "Rust go") for i in range(40)] + [(40, "haskell"), (41, None), (42, "go"), (42, "rust")]
    met, join = [], TS.keyed_block_join
    monkeypatch.setattr(TS, "keyed_block_join", lambda left, right, *args: met.append((left.count(), right.count())) or join(left, right, *args))
    found = TS.search_texts(
        spark.createDataFrame(corpus, "id string, text string"), spark.createDataFrame(asked, "id long, text string"), 7, 0.5
    ).collect()
    assert met[0][0] <= 3 and met[0][1] <= 8
    best = [(None, 1.0), ("d", round(3 / math.sqrt(10), 12)), ("e", round(3 / math.sqrt(10), 12))]
    best += [(f"c{i:03}", round(2 / math.sqrt(10), 12)) for i in range(4)]
    for query in [*range(40), 42]:
        rows = sorted((r["rank"], r["match_id"], r["similarity"]) for r in found if r["query_id"] == query)
        assert [r[1:] for r in rows] == best
    assert len(found) == 41 * 7


def test_an_upsert_moves_each_row_once_and_whole(spark):
    """Aggregates that carry whole rows for each column, and a second shuffle for the join, fill the disks."""
    kind = "comment_id string, body string, score long"
    old = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "n", 4), ("e", "e", 9)]
    new = [("a", "z", 7), ("a", "w", 8), ("c", "q", 5), ("c", "p", 6), ("c", "p", 4), (None, "m", 1), (None, "l", 2), ("d", None, None)]
    merged = U.upsert_comments(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    # The updated column of the last row by (body, score), the others of the first; a null key equals none.
    expected = [("a", "x", 7), ("a", "y", 7), ("b", "x", 3), (None, "n", 4), ("e", "e", 9), ("c", "p", 5), (None, "l", 1), ("d", None, None)]
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(expected, key=repr)
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_large_upsert_takes_turns(spark, monkeypatch):
    """Keys take turns, each a shuffle of its own that is gone when its rows are written; null keys come along whole."""
    kind = "comment_id string, body string, score long"
    old = [(f"c{i}", f"old {i}", i) for i in range(0, 200, 2)] + [(None, "n", 4), ("c0", "twice", 5)]
    new = [(f"c{i}", f"new {i}", 1000 + i) for i in range(150)] + [(None, "m", 1), (None, "l", 2), ("c7", "again", 3)]
    sides = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    once = sorted(map(tuple, U.upsert_comments(*sides).collect()), key=repr)
    written = []
    monkeypatch.setattr(U, "materialize", lambda df, *args: written.append(df.count()) or materialize(df, *args))
    assert sorted(map(tuple, U.upsert_comments(*sides).collect()), key=repr) == once and not written
    monkeypatch.setattr(U, "TURN_ROWS", 80)
    assert sorted(map(tuple, U.upsert_comments(*sides).collect()), key=repr) == once
    assert len(written) == 4 and sum(written) == len(once) and max(written) < 0.5 * len(once)
    # Rows that are drawn may be others each time they are read.
    written.clear()
    drawn = sides[0].withColumn("score", (F.rand() * 9).cast("long"))
    assert U.upsert_comments(drawn, sides[1]).count() == len(once) and not written


def test_a_large_feed_is_merged_a_few_buckets_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(BT, "TURN_ROWS", 30)
    folded, at_once = [], U.upsert_at_once
    monkeypatch.setattr(U, "upsert_at_once", lambda old, new, *args: folded.append((old.count(), new.count())) or at_once(old, new, *args))
    table = BucketTable(str(tmp_path), ["post_id"], 8)
    rows = [(f"p{i}", f"t{i}", i, 1) for i in range(100)] + [(None, "n", 0, 1)]
    U.merge_posts(table, _posts(spark, rows))
    U.merge_posts(table, _posts(spark, [(f"p{i}", "ignored", 2 * i, 2) for i in range(90)] + [("q", "t", 1, 1)]))
    assert [sum(n for _, n in part) for part in (folded[:4], folded[4:])] == [101, 91] and len(folded) == 4 + 4
    assert max(new for _, new in folded) < 50 and sum(old for old, _ in folded) == 101
    expected = [(f"p{i}", f"t{i}", 2 * i if i < 90 else i, 2 if i < 90 else 1) for i in range(100)] + [(None, "n", 0, 1), ("q", "t", 1, 1)]
    assert sorted(map(tuple, table.read(spark).collect()), key=repr) == sorted(expected, key=repr)
    assert sorted(map(tuple, table.read(spark, before=2).collect()), key=repr) == sorted(rows, key=repr)
    assert set(table.read(spark).columns) == {"post_id", "title", "score", "fetched_at"}
