"""Token counts, fingerprints, licence scan, extraction and chat repair against plain versions."""

import hashlib
import itertools
import re

import pytest
from llm_helpers import ODD_TEXTS
from pyspark.sql import functions as F

from colloquy.llm import chat_repair, fingerprints, html_extract, license_scan, token_counts
from colloquy.llm.labelled_pages import labelled_pages, layout_families
from colloquy.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_token_counts_equal_the_library(spark, base, library, odd):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for table in (docs, odd):
        for row in token_counts.token_counts(table, VOCABULARY).collect():
            assert row["n_tokens"] == len(library.encode(row["text"] or "", add_special_tokens=False).ids)


def test_token_counts_of_odd_texts(library):
    counter = token_counts.PrefixCounter(VOCABULARY)
    for text in ODD_TEXTS:
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:40])


def test_stored_prefixes_answer_without_encoding(spark, library, documents):
    docs = documents([(1, "It's 2 antidisestablishment's  naïve 'velvet 日本!!", "a"), (2, None, "a"), (3, "we'll see", "a")])
    stored = token_counts.store_prefix_counts(docs, VOCABULARY).cache()
    for row in stored.collect():
        text = row["text"] or ""
        for end in range(len(text) + 1):
            asked = stored.where(F.col("doc_id") == row["doc_id"]) if end % 9 == 0 else None
            expected = len(library.encode(text[:end], add_special_tokens=False).ids)
            if asked is not None:
                got = asked.select(token_counts.count_at(F.col("prefix_counts"), F.lit(end)).alias("n")).head()["n"]
                assert got == expected
    most = stored.select("text", token_counts.longest_within(F.col("prefix_counts"), F.lit(3)).alias("n")).collect()
    for row in most:
        counts = [len(library.encode(row["text"][:i], add_special_tokens=False).ids) for i in range(len(row["text"]) + 1)]
        assert row["n"] == max(i for i, c in enumerate(counts) if c <= 3)


def test_token_counts_of_nothing(nothing):
    assert token_counts.token_counts(nothing, VOCABULARY).collect() == []


def _next_texts(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_fingerprints_follow_their_neighbours(spark, base, partitions):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["doc_id"]: r for r in fingerprints.edit_fingerprints(docs, partitions).collect()}
    assert len(found) == len(rows)
    for (doc_id, text), (_, following) in _next_texts(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, after = fingerprints.fingerprints([edited.encode(), text.encode(), following.encode()])
        assert row["near_edited"] == fingerprints.containment(changed, own)
        assert row["near_next"] == fingerprints.containment(changed, after)
        assert row["fingerprint"] == fingerprints.pack(changed)


def test_fingerprints_of_odd_rows(odd, nothing, documents):
    rows = fingerprints.edit_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r["n_chars"] == 0]
    assert empty and all(r["fingerprint"] == b"" for r in empty)
    assert fingerprints.edit_fingerprints(nothing).collect() == []
    single = fingerprints.edit_fingerprints(documents([(1, "abcdef", "a")])).head()
    assert single["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and single["near_next"] == 1.0


def test_chunks_survive_an_insertion():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(3000)).encode()
    moved = text[:500] + b"some inserted words " + text[500:]
    a, b = fingerprints.fingerprints([text, moved])
    assert fingerprints.containment(a, b) > 0.95
    cuts = [fingerprints.fingerprints([part])[0] for part in (text, moved)]
    assert cuts == [a, b]  # the same alone and in a batch


def _plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return words, sorted(places)


def test_license_scan_against_a_plain_scan(spark, base, odd):
    extra = "Used under the MIT  License, CC-BY, GNU\nGeneral Public License; Apache license cc by cc by.\n"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", F.concat("text", F.lit("\n" + extra)).alias("text"))
    for table in (docs, odd.select("doc_id", "text")):
        for row in license_scan.license_scan(table).collect():
            words, places = _plain_scan(row["text"])
            assert row["n_words"] == len(words)
            assert [(p["start"], p["label"]) for p in row["places"]] == places


def test_notices_are_exactly_those_that_brute_force_finds(documents):
    notice = license_scan.TEMPLATES[7][1]
    part = " ".join(notice.split()[:-3])
    texts = [
        notice, part, " ".join(notice.split()[:10]), "intro words\n" + notice.upper() + "\nend", ("filler " * 300) + part + (" filler" * 300),
        "Licensed under CC BY-NC 4.0.", "the and of to in is with this", None, "", "This is free and unencumbered software.",
    ]
    docs = documents([(i, t, "a") for i, t in enumerate(texts)])
    sets = [(label, set(license_scan.words_of(t))) for label, t in license_scan.TEMPLATES]
    for row in license_scan.license_scan(docs).collect():
        expected = set()
        at = 0
        for line in license_scan._lines(row["text"]):
            for start, block in license_scan._blocks(line):
                for label, words in sets:
                    share = len(words & set(block)) / len(words)
                    if share >= license_scan.THRESHOLD:
                        expected.add((label, share, at + start))
            at += len(line)
        assert {(n["label"], n["containment"], n["start"]) for n in row["notices"]} == expected
    assert license_scan.license_scan(documents([])).collect() == []


def test_wrapped_notices_are_found(documents):
    import textwrap

    rows, expected = [], {}
    for label, template in license_scan.TEMPLATES:
        for mark in ("", " * ", "# "):
            for around in ("", "filler words stand here\n" * 60):
                wrapped = "\n".join(mark + line for line in textwrap.wrap(template, 72 - len(mark)))
                expected[len(rows)] = label
                rows.append((len(rows), around + wrapped + "\n" + around, "a"))
    longest = {t: max(len(set(license_scan.words_of(x)) & set(license_scan.words_of(t))) for x in textwrap.wrap(t, 72)) for _, t in license_scan.TEMPLATES}
    assert any(n < 0.8 * len(set(license_scan.words_of(t))) for t, n in longest.items())
    for row in license_scan.license_scan(documents(rows)).collect():
        found = {n["label"]: n["containment"] for n in row["notices"] if n["containment"] == 1}
        assert expected[row["doc_id"]] in found
        words = license_scan.words_of(row["text"])
        for n in row["notices"]:
            near = set(words[n["start"]:n["start"] + 128])
            assert any(len(near & own) >= 0.8 * len(own) for own in (set(license_scan.words_of(t)) for k, t in license_scan.TEMPLATES if k == n["label"]))


def test_extraction_on_labelled_pages_held_out():
    pages = html_extract.labelled_pages()
    # Layouts repeat every 12, 13 and 17 pages: a fifth of the pages has combinations never seen.
    model = html_extract.train([p for i, p in enumerate(pages) if i % 5])
    right = total = 0
    for page in pages[::5]:
        nodes = html_extract.parse(page)
        states = [0] * len(nodes)
        for i, node in enumerate(nodes):
            states[i] = node.label if node.label is not None else states[node.parent] if i else 0
        for state, p in zip(states, model.marginals(nodes)):
            total += 1
            right += (p > 0.5) == bool(state)
    assert right / total > 0.97


def test_marginals_equal_brute_force():
    model = html_extract.default_model()
    nodes = html_extract.parse("<div><nav><a href=x>menu</a></nav><p>Some text, with marks. Yes.</p></div>")
    import math

    features = html_extract._features(nodes)
    weights = []
    for states in itertools.product((0, 1), repeat=len(nodes)):
        log = model.root[states[0]]
        for i, s in enumerate(states):
            log += sum(html_extract.feature_weight(f, nodes[i]) * model.seen.get(f, (0.0, 0.0))[s] for f in features[i])
            if i:
                log += model.edges[html_extract._edge(nodes[i]), states[nodes[i].parent], s]
        weights.append((states, math.exp(log + 100)))
    total = sum(w for _, w in weights)
    for i, p in enumerate(model.marginals(nodes)):
        assert p == pytest.approx(sum(w for s, w in weights if s[i]) / total, abs=1e-9)


_FOX = "The quick brown fox jumps over the lazy dog, and then it rests. "
_LAYOUTS = [
    ("<body><div><div>{p}{p}</div></div></body>", 2, ""), ("<body>{p}{p}</body>", 2, ""),
    ("<body><section><h2>One</h2>{p}</section><section><h2>Two</h2>{p}</section></body>", 2, ""),
    ("<body><section><h2>Story</h2>{p}{p}</section><section><h2>Comments</h2><p>Nice post, thanks.</p></section></body>", 2, "Nice"),
    ("<body><center><font size=2>{t}<br><br>{t}</font></center></body>", 2, ""),
    ('<body><div class="inhalt">{p}{p}</div><div class="fusszeile"><p>Impressum und Datenschutz.</p></div></body>', 2, "Impressum"),
    ('<body><article><h1>T</h1>{p}<div class="section notice-boards">{p}</div>{p}</article></body>', 3, ""),
    ("<body><article><h1>T</h1>{p}<form><select><option>one</option></select><button>Go</button></form>{p}</article></body>", 2, "Go"),
    ("<body><form action=x><div><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></div><div>{p}{p}</div><input></form></body>", 2, "Home"),
    ("<body><nav><a href=/>Home</a></nav><main>{p}</main><footer>(c) x</footer></body>", 1, "Home"),
    ("<body><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></body>", 0, "Home"),
    ("<body><table width=100%><tr><td width=150><p><a href=/a>Home</a></p><p><a href=/b>News</a></p></td><td>{p}{p}</td></tr></table></body>", 2, ""),
]


@pytest.mark.parametrize("page, parts, dropped", _LAYOUTS)
def test_ordinary_layouts(page, parts, dropped):
    """Layouts without an article element or telling names; none of these pages is in the training."""
    text = html_extract.main_text(page.format(t=_FOX * 3, p=f"<p>{_FOX * 3}</p>"), html_extract.default_model())
    assert text.count("quick") == 3 * parts and (not dropped or dropped not in text)


def test_layout_families_held_out():
    """Each family is read by a model that has never seen it."""
    families = layout_families()
    for family, pages in families.items():
        others = [p for f, q in families.items() if f != family for p in q]
        model = html_extract.train(labelled_pages(families=False) + others)
        right = total = 0
        for page in pages:
            nodes = html_extract.parse(page)
            states = [0] * len(nodes)
            for i, node in enumerate(nodes):
                states[i] = node.label if node.label is not None else states[node.parent] if i else 0
            shown = [any(isinstance(p, str) and p.strip() for p in n.pieces) for n in nodes]
            told = [(m > 0.5) == bool(s) for m, s, x in zip(model.marginals(nodes), states, shown) if x]
            right, total = right + sum(told), total + len(told)
            assert html_extract.main_text(page, model)
        assert right / total > 0.92, family


def test_main_text_of_the_given_pages(spark, base):
    import html as entities

    for row in QUERIES["op1_main_text"](spark, base).join(spark.read.parquet(f"{base}/pages.parquet"), ["page_id", "url"]).collect():
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S).group(1)
        inside = re.sub(r"<br>|</?p>|</?h1>", " ", inside)
        assert row["text"] == " ".join(entities.unescape(re.sub(r"<[^>]+>", "", inside)).split())
        assert row["n_chars"] == len(row["text"])


def test_pages_without_optional_tags(spark, base):
    model = html_extract.default_model()
    article = "<article><h1>T</h1><p>a b c, and so on.<p>second, one.</article>"
    for page in (
        f"<html><head><title>x</title><body>{article}", f"<head><meta charset=utf-8><title>x</title>{article}",
        f"<title>x</title>{article}", f"<html><head><title>x</title><noscript><link href=y><body>{article}</body></html>",
        f"<head><style>p {{}}</style><div>{article}</head></div>", f"<head></head><body>{article}",
    ):
        assert html_extract.main_text(page, model) == "T a b c, and so on. second, one."
    pages = [r["html"] for r in spark.read.parquet(f"{base}/pages.parquet").limit(30).collect()]
    for page in pages:
        assert html_extract.main_text(page.replace("</head>", ""), model) == html_extract.main_text(page, model) != ""


def test_extraction_of_odd_pages(spark):
    deep = "<div>" * 3000 + "<article><p>deep text, here it is.</p></article>"
    pages = [
        (1, None), (2, ""), (3, "<"), (4, "<!-- only --><script>x</script>"), (5, deep),
        (6, "<article><h1>T &amp; U</h1><p>a&nbsp;b\n c, and so on.<p>second, one.</article><section class=comments><p>Bad, very bad.</p></section>"),
    ]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert found[1] == found[2] == found[4] == ""
    assert found[5] == "deep text, here it is."
    assert found[6] == "T & U a b c, and so on. second, one."
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def _cheapest(roles):
    best = None
    for path in itertools.product(range(1, 4), repeat=len(roles)):
        state, cost = 0, 0
        for own, after in zip(roles, path):
            cost += chat_repair.step(own, state, after)[0]
            state = after
        cost += chat_repair.ENDS[state]
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_costs_equal_brute_force_and_are_legal(spark, partitions):
    names = ["user", "assistant", "system", "tool", None, "Human", " GPT "]
    convs = [list(c) for c in itertools.product(names[:4], repeat=3)] + [
        ["user"] * 6, ["assistant"] * 5, ["system", "system", "user", "user"], [None, None], ["Human", " GPT ", "Human"],
        ["assistant", "user", "system", "assistant", None, "user"], ["system"],
    ]
    rows = [(c, i, r, f"t{i}") for c, conv in enumerate(convs) for i, r in enumerate(conv)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat_repair.repair(turns, partitions).collect(), key=lambda r: r["pos"])
    assert len(out) == len(rows)
    for c, conv in enumerate(convs):
        own = [r for r in out if r["conv_id"] == c]
        assert {r["conversation_cost"] for r in own} == {_cheapest([chat_repair.role_number(r) for r in conv])}
        text = "".join(r["fragment"] for r in own)
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert re.fullmatch(r"(system )?(user assistant )*(user )?", "".join(r + " " for r in roles)), roles
        assert roles != ["system"] and text.count("<|im_end|>") == len(roles) and text.endswith("<|im_end|>\n")
        assert all(f"t{i}" in text for i in range(len(conv)))


def test_repair_does_not_depend_on_the_cuts(spark):
    rows = [(1, i, ["user", "assistant", "tool", "user", "user"][i * 7 % 5], f"x{i}") for i in range(300)]
    rows += [(None, 1, "user", None), (None, None, None, ""), (2, 1, "user", "<|im_end|> hi"), (2, 1, "user", "<|im_end|> hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    keep = ["conv_id", "turn", "role", "new_role", "action", "inserted", "conversation_cost", "fragment"]
    a, b = (sorted(map(str, chat_repair.repair(turns, n).select(*keep).collect())) for n in (1, 11))
    assert a == b
    assert chat_repair.repair(turns.where("false")).collect() == []
