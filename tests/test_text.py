"""Scalar functions, responses, pages, feeds and sinks on hand-made rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions import html as HT
from colloquy.functions import markdown as M
from colloquy.functions import predicates as P
from colloquy.functions import responses as R
from colloquy.functions import text as X
from colloquy.functions import vectors as V
from colloquy.operators import digest as DG
from colloquy.operators.related import find_structurally_related
from colloquy.sources import digests, embeddings, feeds, pages
from colloquy.operators.upsert import publish_version, read_current


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize("a,b,cos", [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 1.0], 0)])
def test_cosine(spark, a, b, cos):
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    assert one(spark, V.cosine(lit(a), lit(b))) == pytest.approx(cos)


def test_cosine_of_different_lengths_fails(spark):
    with pytest.raises(Exception, match="dimension"):
        one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


@pytest.mark.parametrize("p1,p2,told", [
    ("supports", "opposes", True), ("opposes", "supports", True), ("has", "missing", True), ("adopted", "rejected", True),
    ("migrated-to", "migrated-from", True), ("supports", "uses", False), ("supports", "supports", False), ("", "", False),
])
def test_opposites(spark, p1, p2, told):
    assert one(spark, P.are_opposite(F.lit(p1), F.lit(p2))) is told


@pytest.mark.parametrize("o1,o2,told", [
    ("has-memory-safety", "lacks-memory-safety", True), ("HAS-Feature", "LACKS-Feature", True), ("missing x", "has x", True),
    ("has-feature-x", "has-feature-y", False), ("is not a", "is not b", False), ("is fast", "is not fast", True), ("can do", "cannot do", True),
])
def test_negated_objects(spark, o1, o2, told):
    assert one(spark, P.are_negated(F.lit(o1), F.lit(o2))) is told


@pytest.mark.parametrize("column,expected", [
    (lambda: X.human_date(F.lit("2025-12-27")), "Saturday, December 27, 2025"),
    (lambda: X.human_date(F.lit("soon")), "soon"),
    (lambda: X.slug(F.lit("Hello, World! 2")), "hello-world-2"),
    (lambda: X.confidence_bar(F.lit(0.85)), "█████████░ 85%"),
    (lambda: X.claim_display(F.lit("a-b"), F.lit("is-better-than"), F.lit("<c>"), F.lit(0.875)), "a b is better than &lt;c&gt; *(88% confident)*"),
    (lambda: X.first_sentence(F.lit("One two. Three")), "One two."),
    (lambda: X.cut_words(F.lit("aaaa bbbb cccc dddd"), 12), "aaaa bbbb..."),
    (lambda: X.url_domain(F.lit("https://www.Example.com:80/a")), "example.com"),
    (lambda: X.url_domain(F.lit("not a url")), ""),
    (lambda: X.first_integer(F.lit("about 123 points")), 123),
    (lambda: X.first_integer(F.lit("none")), 0),
    (lambda: X.decode_entities(F.lit("a &amp;lt; &#65;&#x42; &nope; &hellip;")), "a &lt; AB &nope; …"),
    (lambda: X.mask_injections(F.lit("Please IGNORE  previous rules; System: x")), "Please [FILTERED] rules; [FILTERED] x"),
    (lambda: X.is_internal_host(F.lit("172.20.1.1")), True),
    (lambda: X.is_internal_host(F.lit("db.internal")), True),
    (lambda: X.is_internal_host(F.lit("example.com")), False),
    (lambda: X.token_estimate(F.lit("abcde")), 2),
    (lambda: X.link_prompt(F.lit("T"), F.lit("c" * 60), F.lit("d.com"), F.lit(None), 55), 'Linked Article: "T"\nSource: d.com\n\n' + "c" * 55 + "..."),
    (lambda: X.link_prompt(F.lit(None), F.lit(None), F.lit(None), F.lit(None)), "(Link post - external content could not be fetched)"),
])
def test_text(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize("text,summary", [
    ('{"summary":"s"}', "s"),
    ('x ```json\n{"summary":"s"}\n``` y', "s"),
    ('so {"summary":"s {deep}","key_topics":[]} ok', "s {deep}"),
    ('so {"summary":"a } b"} and } more', "a } b"),
    ("nothing", None),
    ('{"summary":"s","confidence":3}', None),
    ('{"summary":"s","sentiment":"angry"}', None),
    ('{"title":"no summary"}', None),
])
def test_responses(spark, text, summary):
    rows = R.parse_responses(spark.createDataFrame([(text,)], "t string"), "t", R.SUMMARY).head()["response"]
    assert rows["summary"] == summary and rows["parse_ok"] is (summary is not None)
    if summary:
        assert rows["confidence"] == 0.7 and rows["sentiment"] == "neutral" and rows["missing_context"] == []


def test_claim_responses(spark):
    good = '{"claims":[{"subject":"a","predicate":"has","object":"b"},{"subject":"c","predicate":"has","object":"d","confidence":0.95}]}'
    bad = '{"claims":[{"subject":"a","predicate":"has"}]}'
    df = spark.createDataFrame([(1, good), (2, bad)], "id int, t string")
    rows = R.claims_from_responses(df, "t", ["id"]).orderBy("claim_pos").collect()
    assert [(r["id"], r["subject"], r["confidence"], r["verification_status"], r["source_stance"]) for r in rows] == [
        (1, "a", 0.5, "unverified", "neutral"), (1, "c", 0.95, "verified", "neutral")]


LONG = "word " * 40


@pytest.mark.parametrize("html,domain,title,text", [
    (f"<title> A &amp;amp; B </title><nav>menu</nav><article><p>{LONG}</p></article><footer>f</footer>", "", "A & B", LONG.strip()),
    (f'<meta property="og:title" content="Og"><body><div class="sidebar">{LONG}</div><main>{LONG}x</main></body>', "", "Og", LONG + "x"),
    (f"<body><h1>H</h1><div>{LONG * 2}<script>var a=1;</script></div><div>short</div></body>", "", "H", (LONG * 2).strip()),
    ("<body>tiny <b>text</b></body>", "", "", "tiny text"),
    ('<body><div class="readme">Read <span class="octicon">x</span>me</div></body>', "github.com", "", "Read me"),
    ('<div role="main">' + LONG + "</div><div role='navigation'>n</div>", "", "", LONG.strip()),
    ("", "", "", ""),
])
def test_pages(spark, html, domain, title, text):
    df = spark.createDataFrame([(html, domain)], "html string, domain string")
    row = pages.with_article(df, F.col("domain")).head()
    assert (row["title"], row["content"]) == (title, text)
    assert len(row["excerpt"]) <= 303


def test_selectors():
    root = HT.parse('<div class="a b" id="x"><p>1<p>2</div><ul><li>3<li>4</ul>')
    assert [e.text() for e in root.every("p")] == ["1", "2"]
    assert root.first(".a.b p").text() == "1" and root.first("#x").tag == "div" and root.first(".a.c") is None
    assert [e.text() for e in root.every("ul li")] == ["3", "4"]


def test_link_contents_of_stored_pages(spark):
    links = spark.createDataFrame([("1", "https://a.com/x"), ("2", "http://localhost/x"), ("3", "https://x.com/p"), ("4", "https://b.com/none"), ("5", "junk")], "post_id string, url string")
    stored = spark.createDataFrame([("https://a.com/x", f"<title>T</title><article>{LONG * 40}</article>")], "url string, html string")
    got = {r["post_id"]: r for r in pages.link_contents(links, stored, max_length=100).collect()}
    assert got["1"]["truncated"] and got["1"]["content"].endswith("...") and len(got["1"]["content"]) == 103
    assert got["2"]["error"].startswith("Blocked") and got["3"]["error"] == "Domain x.com is blocked"
    assert got["4"]["error"] == "Page not stored" and "5" not in got


def test_feed_files(spark, tmp_path):
    entry = '<entry><author><name>/u/ann</name></author><link href="{}"/><title>T &amp; U</title><updated>2024-01-05T10:00:00+00:00</updated></entry>'
    body = entry.format("https://www.reddit.com/r/prog/comments/AbC1/title/?x=1") + entry.format("https://www.reddit.com/r/prog/wiki")
    (tmp_path / "feed.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')
    rows = feeds.read_feeds(spark, str(tmp_path)).collect()
    assert [(r["post_id"], r["permalink"], r["author"], r["subreddit"], r["title"]) for r in rows] == [
        ("AbC1", "/r/prog/comments/AbC1/", "ann", "prog", "T & U")]


def test_thread_page(spark):
    html = (
        '<div class="thing link" data-fullname="t3_p1"><p class="title"><a class="title" href="#">Hi</a></p><a class="author">op</a>'
        '<div class="score unvoted">12 points</div><a class="comments">3 comments</a><time datetime="2024-01-05T10:00:00Z"></time></div>'
        '<div class="thing comment" data-fullname="t1_c1"><a class="author">al</a><div class="usertext-body"><div class="md">One</div></div><div class="child">'
        '<div class="thing comment" data-fullname="t1_c2"><a class="author">bo</a><div class="usertext-body"><div class="md">Two</div></div></div></div></div>'
        '<div class="thing comment" data-fullname="t1_c3"><div class="usertext-body"><div class="md">Three</div></div></div>'
        '<div class="thing comment"><div class="usertext-body"><div class="md">no id</div></div></div>'
    )
    posts, comments = pages.parse_thread_pages(spark.createDataFrame([("/r/prog/comments/p1/", html)], "permalink string, html string"))
    post = posts.head()
    assert (post["post_id"], post["title"], post["author"], post["score"], post["num_comments"], post["subreddit"]) == ("p1", "Hi", "op", 12, 3, "prog")
    rows = {r["comment_id"]: (r["parent_id"], r["author"], r["body"]) for r in comments.collect()}
    assert rows == {"c1": ("p1", "al", "One"), "c2": ("c1", "bo", "Two"), "c3": ("p1", "[deleted]", "Three")}


def test_embedder_errors_are_kept(spark):
    def fails(texts):
        raise ValueError("no model")

    claims = spark.createDataFrame([("k", "a", "has", "b", None, True)], "claim_id string, subject string, predicate string, object string, embedding array<float>, is_canonical boolean")
    report = embeddings.backfill_report(embeddings.backfill_embeddings(claims, embeddings.Embedder("broken", 2, fails))).head()
    assert (report["processed"], report["errors"]) == (0, 1)
    done = embeddings.backfill_embeddings(claims, embeddings.Embedder("twos", 2, lambda ts: [[2.0, 2.0] for _ in ts])).head()
    assert list(done["embedding"]) == [2.0, 2.0] and done["embedding_model"] == "twos"


def test_structural_limit(spark):
    rows = [(f"c{i:02d}", "s", f"p{i % 2}", "o", True) for i in range(20)]
    claims = spark.createDataFrame(rows, "claim_id string, subject string, predicate string, object string, is_canonical boolean")
    got = find_structurally_related(claims, claims.where("claim_id = 'c00'"), 3).orderBy("rank").collect()
    assert [(r["related_id"], r["relationship"]) for r in got] == [("c01", "same-subject"), ("c02", "same-subject"), ("c03", "same-subject")]


def test_markdown_blocks(spark):
    empty = F.array().cast("array<struct<type:string,insight:string>>")
    assert one(spark, M.threads_block(empty)) == ""
    assert one(spark, M.what_matters_row(F.lit("urgent"), F.lit("[x]"), F.lit("i"), F.lit("s"))) == "| 🔴 **\\[x\\]** | i | s |\n"


def test_digest_files_hold_the_document(spark, tmp_path):
    ranked = spark.createDataFrame(
        [("2024-01-02", f"p{i}", "sub", f"Title {i}", "http://u", 10 + i, 3, f"Sum {i}. More", "neutral", "none", 0.9, ["c"], 80 - i, i + 1, i == 3) for i in range(4)],
        "digest_date string, post_id string, subreddit string, title string, url string, score long, num_comments long, summary string, sentiment string,"
        " controversy_level string, confidence double, missing_context array<string>, importance_score long, importance_rank long, is_low_activity boolean",
    ).withColumn("digest_date", F.to_date("digest_date"))
    claims = spark.createDataFrame([("k", "p0", "Rust", "is-better-than", "C", 0.95, 1)], "claim_id string, post_id string, subject string, predicate string, object string, confidence double, extracted_at long")
    digests.write_digests(DG.digest_fragments(ranked, claims, title="News"), str(tmp_path / "out"))
    parts = sorted(glob.glob(os.path.join(tmp_path, "out", "digest_date=2024-01-02", "*.txt")))
    text = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert text.startswith("# News - 2024-01-02\n\n*Tuesday, January 2, 2024 • 4 posts • 1 subreddits • 1 claims extracted*\n\n## What Matters\n\n")
    places = [text.index(t) for t in ("| 🔴 **Title 0**", "**Note:**", "## Top Discussions", "### [Title 0](http://u) • r/sub", "✓ Rust is better than C (95%)",
                                      "## r/sub", "### [Title 2](http://u) {#title-2}", "## Low-Activity Posts", "1 post with limited", "</details>")]
    assert places == sorted(places) and text.endswith("</details>\n\n")


def test_versioned_publishing(spark, tmp_path):
    path = str(tmp_path / "themes")
    publish_version(spark.range(2), path, "a")
    publish_version(spark.range(5), path, "b")
    assert read_current(spark, path).count() == 5


def test_json_is_found_as_by_parsing_every_try(spark):
    """A text is parsed only where it opens like an object, and a fenced block is looked for once."""
    def strict(text):
        variant = F.try_parse_json(text)
        return F.when(variant.isNotNull() & F.schema_of_variant(variant).startswith("OBJECT"), text)

    text = F.col("t")
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    widest = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    tries = F.coalesce(
        strict(text), strict(F.when(fenced != "", F.trim(fenced))), strict(F.when(widest != "", widest)), R._first_balanced(text)
    )
    inner = ['{"a": 1}', '{"a": {"b": "}"}}', "{}", "[1]", "null", "1", '"s"', "{a: 1}", '{"a": 1, "a": 2}', "{'a': 1}", '{"a": 1', "", " ", "{", "}"]
    around = ["%s", " %s ", "\n\t%s\r\n", "\f%s", " %s", "﻿%s", "　%s", "x %s y", "x %s y } z", "```json\n%s\n```", "``` %s```", "```json\t%s", "{ %s", "```\n```%s", "/* c */ %s"]
    rows = [(a.replace("%s", i),) for a in around for i in inner] + [(None,)]
    found = spark.createDataFrame(rows, "t string").select(text, R.json_object(text).alias("now"), tries.alias("then"))
    assert [r for r in found.collect() if r["now"] != r["then"]] == []
    plan = spark.createDataFrame(rows, "t string").select(R.json_object(text).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:json)?") == 1
