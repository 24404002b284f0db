"""Threads, selection, limits and ordered totals against plain models, with hot keys."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import signals as Signals
from colloquy.operators import controversy as K
from colloquy.operators import prompts as PR
from colloquy.operators import selection as S
from colloquy.operators import threads as J
from colloquy.operators.ordered import row_numbers, running_total
from colloquy.operators.rate_limit import admit, rate_limit_audit
from colloquy.operators.upsert import apply_stance_events, upsert
from colloquy.session import materialize

COLUMNS = "comment_id string, post_id string, parent_id string, author string, body string, score long, created_at timestamp"


def comments(spark, rows):
    """rows: (id, parent or None, score[, post])"""
    data = []
    for n, (cid, parent, score, *post) in enumerate(rows):
        post = post[0] if post else "p"
        data.append((cid, post, f"t1_{parent}" if parent else f"t3_{post}", f"u{n % 5}", "x" * (40 + n % 90), score, n))
    df = spark.createDataFrame(data, COLUMNS.replace("timestamp", "long"))
    return df.withColumn("created_at", F.timestamp_seconds("created_at"))


def test_chain_and_two_roots(spark):
    forest = J.build_forest(comments(spark, [("1", None, 5), ("2", "1", -2), ("3", "2", 7), ("4", None, 1), ("5", "gone", 2)]))
    got = {r["comment_id"]: (r["root_id"], r["depth"], r["total_score"], r["reply_count"], r["height"]) for r in forest.collect()}
    assert got == {"1": ("1", 0, 10, 2, 3), "2": ("1", 1, 5, 1, 2), "3": ("1", 2, 7, 0, 1), "4": ("4", 0, 1, 0, 1), "5": ("5", 0, 2, 0, 1)}


def test_cycles_are_left_out(spark):
    forest = J.build_forest(comments(spark, [("1", None, 1), ("a", "c", 1), ("b", "a", 1), ("c", "b", 1), ("2", "1", 1)]))
    assert {r["comment_id"] for r in forest.collect()} == {"1", "2"}


def test_deep_and_wide_forest(spark):
    """One comment holds a third of all replies; one chain is 90 levels deep."""
    rng = random.Random(3)
    rows = [("r", None, 1)] + [(f"w{i}", "r", rng.randint(-5, 9)) for i in range(100)]
    rows += [(f"d{i}", f"d{i - 1}" if i else "r", rng.randint(-5, 9)) for i in range(90)]
    rows += [(f"x{i}", f"w{rng.randrange(100)}", rng.randint(-5, 9)) for i in range(100)]
    forest = J.build_forest(comments(spark, rows).repartition(6))
    children, score = {}, {}
    for cid, parent, s in rows:
        children.setdefault(parent, []).append(cid)
        score[cid] = s
    order, stack = {}, [("r", 0)]
    expected = {}

    def total(c):
        kids = [total(k) for k in children.get(c, [])]
        expected[c] = (score[c] + sum(k[0] for k in kids), sum(k[1] + 1 for k in kids), 1 + max((k[2] for k in kids), default=0))
        return expected[c]

    total("r")
    got = {r["comment_id"]: (r["total_score"], r["reply_count"], r["height"]) for r in forest.collect()}
    assert got == expected
    while stack:
        node, depth = stack.pop()
        order[node] = (len(order), depth)
        stack.extend((k, depth + 1) for k in reversed(children.get(node, [])))
    flat = {r["comment_id"]: (r["position"], r["depth"]) for r in J.flattened(forest).collect()}
    assert flat == order


def test_rendered_thread(spark):
    rows = [("1", None, 3), ("a", "1", 1), ("b", "1", 9), ("c", "1", 5), ("d", "1", 0), ("e", "b", -4)]
    table = comments(spark, rows)
    text = J.rendered_threads(J.build_forest(table), table).head()["thread_text"].split("\n")
    assert [t.split(" u/")[0] for t in text] == ["[Parent]", "  [Reply]", "    [Reply]", "  [Reply]", "  [Reply]"]
    assert "(+9)" in text[1] and "(-4)" in text[2] and "(+5)" in text[3] and "(+1)" in text[4]


def plain_selection(rows, replies, count):
    good = [r for r in rows if len(r["body"]) >= 50 and r["author"] != "[deleted]"]
    if not good:
        return [r["comment_id"] for r in rows][:count]
    if len(good) <= count:
        return [r["comment_id"] for r in good]
    mean = sum(r["score"] for r in good) / len(good)
    picked = []

    def fill(candidates, upto):
        for c in candidates:
            if len(picked) >= upto:
                return
            if c["comment_id"] not in picked:
                picked.append(c["comment_id"])

    by = lambda key: sorted(good, key=lambda r: (key(r), r["comment_id"]))
    fill(by(lambda r: -r["score"]), 4)
    fill(by(lambda r: -replies.get(r["comment_id"], 0)), 6)
    fill([r for r in by(lambda r: abs(r["score"] - mean)) if "however" in r["body"].lower()], 8)
    fill([r for r in by(lambda r: -len(r["body"])) if r["score"] < mean and r["score"] > -10 and len(r["body"]) > 100], count)
    fill(by(lambda r: -r["score"]), count)
    return picked


def test_diverse_selection_with_a_hot_post(spark):
    rng = random.Random(5)
    data = []
    for n in range(600):
        post = "hot" if n < 300 else f"p{n % 40}"
        parent = f"t1_c{rng.randrange(max(n, 1))}" if rng.random() < 0.5 else f"t3_{post}"
        body = ("However " if rng.random() < 0.1 else "") + "y" * rng.randint(20, 180)
        author = "[deleted]" if rng.random() < 0.1 else f"u{n % 9}"
        data.append((f"c{n}", post, parent, author, body, rng.randint(-30, 80), n))
    data.append(("z1", "short", "t3_short", "a", "tiny", 1, 1000))
    data.append(("z2", "short", "t3_short", "a", "small", 5, 1001))
    df = spark.createDataFrame(data, COLUMNS.replace("timestamp", "long")).withColumn("created_at", F.timestamp_seconds("created_at"))
    wanted, replies = {}, {}
    for r in data:
        parent = r[2].split("_", 1)[1]
        replies[parent] = replies.get(parent, 0) + 1
    for post in {r[1] for r in data}:
        rows = [dict(zip(("comment_id", "post_id", "parent_id", "author", "body", "score"), r)) for r in data if r[1] == post]
        wanted[post] = plain_selection(rows, replies, 10)
    for parts in (1, 7):
        got = {}
        for r in sorted(S.diverse_comments(df.repartition(parts), 10).collect(), key=lambda r: r["pick_no"]):
            got.setdefault(r["post_id"], []).append(r["comment_id"])
        assert got == wanted


def test_running_total_over_a_hot_key(spark):
    rows = [(0 if i < 200 else i % 7, i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, seq long, v long").repartition(9)
    got = {(r["k"], r["seq"]): r["before"] for r in running_total(df, ["k"], [F.asc("seq")], F.col("v"), "before").collect()}
    sums = {}
    for k, seq, v in rows:
        assert got[(k, seq)] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    numbered = row_numbers(df, ["k"], [F.desc("seq")], "place").where("k = 0").orderBy("place").collect()
    assert [r["seq"] for r in numbered[:2]] == [497, 490] and [r["place"] for r in numbered] == list(range(1, len(numbered) + 1))


def test_rate_limit(spark):
    rng = random.Random(1)
    rows, now = [], {"a": 0, "b": 0}
    for i in range(900):
        client = "a" if rng.random() < 0.7 else "b"
        now[client] += rng.choice([500, 1000, 3000, 90_000 if rng.random() < 0.1 else 2000])
        rows.append((client, i, now[client]))
    df = spark.createDataFrame(rows, "client string, request_id long, at_ms long").repartition(5)
    recent = {"a": deque(), "b": deque()}
    expected = {i: admit(recent[c], at, 30, 60_000) for c, i, at in rows}
    assert {r["request_id"]: r["admitted"] for r in rate_limit_audit(df).collect()} == expected
    assert not all(expected.values())


def _scanned(text):
    """Names of the keywords and camps, and the moods, by one search for each word."""
    low = text.lower()
    mood = [any(w in low for w in words) for words in (vocab.POSITIVE_WORDS, vocab.NEGATIVE_WORDS)]
    camps = [c for p, c in vocab.CAMP_PATTERNS if re.search(p, text, re.IGNORECASE | re.ASCII)]
    return [k for k in vocab.CONTROVERSY_KEYWORDS if k in low], camps, *mood


def test_text_signals_equal_a_search_for_each_word(spark):
    random_ = random.Random(3)
    pieces = [*vocab.CONTROVERSY_KEYWORDS, *vocab.POSITIVE_WORDS, *vocab.NEGATIVE_WORDS, "Rust IS", "golang\n vs", "Mac\xa0is", "macOS\tis",
              "microservices are", "microservice is", "VIM vs", "w\u0130ndows", "ta\u212ae", "\u212a", "\u0130", "na\xefve", "that's not true",
              "ta\u212ae hot ta\u212ae", "l\u0130nux is", "bu", "t "]
    texts = ["", " ", *pieces, *(p.upper() for p in pieces), "hot ta\u212ae", "unpopular op\u0130nion", "x" * 100_000 + " HOWEVER"]
    texts += ["".join(random_.choices(pieces, k=4)) + " ".join(random_.choices(pieces, k=3)) for _ in range(200)]
    # No letter but these two has a lower case with an ASCII letter in it.
    assert [c for c in range(128, 0x110000) if any(x < "\x80" for x in chr(c).lower())] == [0x130, 0x212A]
    table = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string").withColumn("s", Signals.text_signals(F.col("text")))
    s = F.col("s")
    got = table.select(
        "i", Signals.keyword_names(Signals.keyword_mask(s)), Signals.camp_names(Signals.camp_mask(s)),
        Signals.is_positive_text(s), Signals.is_negative_text(s), "s",
    ).orderBy("i").collect()
    assert got[0]["s"] == 0
    for row, text in zip(got[1:], texts):
        assert tuple(row)[1:5] == _scanned(text), repr(text)


def test_bodies_are_not_searched_once_for_every_word(spark):
    rows = comments(spark, [("1", None, 5), ("2", "1", -2)])
    plan = K.comment_signals(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") + plan.count("RLIKE") == 0 and plan.count("_found_in(") >= 1


def test_controversy_score_of_a_quiet_post(spark):
    posts = spark.createDataFrame([("p", "Plain title", "nothing here")], "post_id string, title string, content string")
    rows = comments(spark, [("1", None, 3), ("2", None, 4)])
    detected = K.detect_controversy(posts, rows, J.build_forest(rows)).head()
    assert detected["controversy_score"] == 0 and not detected["is_controversial"] and detected["reply_depth"] == 1


@pytest.mark.parametrize("score,comments_,density,told", [(5, 3, "rich", False), (50, 10, "sparse", False), (100, 1, "sparse", True), (20, 1, None, True)])
def test_story_gate(spark, score, comments_, density, told):
    df = spark.createDataFrame([(score, comments_, density)], "s int, n int, d string")
    assert df.select(K.should_narrate(F.col("s"), F.col("n"), F.col("d"))).head()[0] is told


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", 1, 0), ("b", "y", 2, 0)], "id string, body string, score int, at int")
    new = spark.createDataFrame([("a", "changed", 5, 1), ("a", "later", 7, 2), ("c", "z", 9, 1)], "id string, body string, score int, at int")
    got = {r["id"]: (r["body"], r["score"]) for r in upsert(old, new, ["id"], ["score", "at"], "at").collect()}
    assert got == {"a": ("x", 7), "b": ("y", 2), "c": ("z", 9)}


def test_stance_events(spark):
    claims = spark.createDataFrame([("k1", "Rust", "supports", "async code")], "claim_id string, subject string, predicate string, object string")
    stances = spark.createDataFrame(
        [("k1", "agrees", 10.0, 5.0, "agrees", "old")],
        "claim_id string, content_author_stance string, commenter_agree_pct double, commenter_disagree_pct double, user_stance string, user_note string",
    )
    events = spark.createDataFrame(
        [(1, "Rust supports async code", "AGREE", None), (2, "Rust supports async code", "disagree", "hm"), (3, "Go has gc", "agree", None), (4, "too short", "agree", None)],
        "event_at long, claim_text string, stance string, note string",
    ).withColumn("event_at", F.timestamp_seconds("event_at"))
    added, table = apply_stance_events(claims, stances, events)
    assert [(r["subject"], r["object"], r["confidence"]) for r in added.collect()] == [("Go", "gc", 1.0)]
    rows = {r["claim_id"]: (r["content_author_stance"], r["user_stance"], r["user_note"]) for r in table.collect()}
    assert rows["k1"] == ("agrees", "disagrees", "hm") and len(rows) == 2


def test_no_body_is_joined(spark, monkeypatch):
    """Joins of comments carry what is asked of a body, not the body."""
    kind = "comment_id string, post_id string, parent_id string, author string, body string, score long, created_at timestamp"
    rows = [(f"c{i}", "p1", f"t1_c{i // 2}" if i > 3 else "t3_p1", "u", f"{i} " + "wrong " * 90, i, None) for i in range(40)]
    comments = spark.createDataFrame(rows, kind)
    seen = []
    counted = S.reply_counts
    monkeypatch.setattr(S, "reply_counts", lambda df: seen.extend(df.columns) or counted(df))
    assert S.diverse_comments(comments, 10).count() == 10
    assert "post_id" in seen and not {"body", "lowered"} & set(seen)
    shown = J.rendered_threads(J.build_forest(comments), comments)
    assert all("..." in r["thread_text"] for r in shown.collect())
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "shown#" in plan


def test_prompt_lines_are_cut_before_they_are_joined(spark, tmp_path):
    """The join of picks and comments moves lines of a bounded length, not whole bodies."""
    rows = [(f"c{i}", f"p{i % 3}", f"u{i}", f"{i} " + "wrong " * 300, i) for i in range(12)] + [("cx", "p1", None, "no author", 1)]
    spark.createDataFrame(rows, "comment_id string, post_id string, author string, body string, score long").write.parquet(str(tmp_path / "c"))
    comments = spark.read.parquet(str(tmp_path / "c"))
    picks = spark.createDataFrame([("c4", 2), ("c1", 1), ("c5", 1), ("cx", 3)], "comment_id string, pick_no int")
    lines = PR.selected_comment_lines(comments, picks)
    found = {r["post_id"]: (r["comment_lines"], r["shown"]) for r in lines.collect()}
    line = lambda i: f"- u/u{i} ({i} pts): " + rows[i][3][:500]
    assert found == {"p1": (f"{line(1)}\n{line(4)}", 3), "p2": (line(5), 1)}
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(i for i, step in enumerate(plan) if "Join" in step)
    assert not any("body#" in step for step in plan[:joined]) and any("body#" in step for step in plan[joined:])


def test_written_tables_leave_no_shuffle_files(spark):
    """Steps of a job must not pile up on the disks; a setting of the session stays as it is."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    held = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count(".data")
    rows = spark.range(2000).repartition(8, "id").groupBy((F.col("id") % 7).alias("g")).count()
    spark.sparkContext._jvm.System.gc()
    files = held()
    table = materialize(rows)
    assert held() <= files and spark.conf.get(setting, None) == before
    assert sorted(r["count"] for r in table.collect()) == sorted(r["count"] for r in rows.collect())
