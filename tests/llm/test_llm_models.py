"""Token alignment, language prediction and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import ODD_TEXTS
from pyspark.sql import functions as F

from colloquy.llm import alignment, language_id, resampling
from colloquy.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


# Alignment


def _plain_spans(text):
    """Ids and byte spans of both tokenizers, read from the vocabularies entry by entry; None without tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    whole, out = (" " + text).encode(), []
    letters = sorted({c for entry in a.get_vocab() for c in entry if len(entry) == 1})
    byte_of = {}
    for c in letters:
        # A lone byte below 0x80 decodes to itself; others are told by the code point they complete.
        shown = ByteLevel().decode([c])
        if shown != "�":
            byte_of[c] = ord(shown)
    hidden = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b < 0x100)]
    for c in letters:
        byte_of.setdefault(c, ord(c) if ord(c) < 256 else hidden[ord(c) - 256])
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    pieces = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    others = [
        bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, b.id_to_piece(i)) for i in ids_b)
    ]
    for ids, parts in ((ids_a, pieces), (ids_b, others)):
        if not text or b"".join(parts) != whole:
            return None
        at, spans = 0, []
        for i, part in zip(ids, parts):
            spans.append((i, at, at + len(part)))
            at += len(part)
        out.append(spans)
    return out


def _plain_alignment(texts):
    """All figures by comparing every token of one side with every token of the other."""
    found, counts = [], Counter()
    for text in texts:
        spans = _plain_spans(text or "")
        if spans is None:
            found.append(None)
            continue
        a, b = spans
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        counts.update(set(links))
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = f[3]
        rows.append((
            *f[:3], len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(f[4].encode()).hexdigest(),
        ))
    return rows


def _given_texts(spark, base, most):
    texts = [r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").orderBy("doc_id").collect()]
    return [t for t in texts if len(t) < 1500][:most]


def test_alignment_equals_plain_comparison(spark, base, documents):
    texts = _given_texts(spark, base, 25) + [t for t in ODD_TEXTS if len(t) < 800] + [
        None, " lead", "a  b", "l▁x", "<s> </s> <|endoftext|>", "one two", "one two", "\x00", "naïve über", "İß"
    ]
    rows = alignment.align(documents([(i, t, "a") for i, t in enumerate(texts)]), *PATHS).orderBy("doc_id").collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for row, plain, text in zip(rows, _plain_alignment(texts), texts):
        assert tuple(row[n] for n in names) == plain, repr(text)


def test_rare_pairs_meet_their_counts_in_a_shuffle(spark, base, documents):
    table = documents([(i, t, "a") for i, t in enumerate(_given_texts(spark, base, 120))])
    aligned = alignment.alignments(table, *PATHS, keep_groups=False).cache()
    counts = alignment.pair_counts(aligned).cache()
    everywhere = sorted(map(tuple, alignment.link_scores(aligned, counts).collect()))
    assert alignment._least_count(counts, 50) > 1
    for rows in (50, 1):
        assert sorted(map(tuple, alignment.link_scores(aligned, counts, rows=rows).collect())) == everywhere


def test_links_take_no_python_call_each():
    n = 1000
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        groups, links = alignment.align_ids([0, 1] * n, [0, 1] * n, np.array([1, 2]), np.array([2, 1]), alignment._Spelled())
    finally:
        sys.setprofile(None)
    assert groups == ["0,1|0,1"] * n
    assert Counter(links.tolist()) == {0: n, 1 << 32: n, 1 << 32 | 1: n}
    assert len(calls) < 100


def test_slices_without_common_ends_are_linked_by_overlap():
    random_ = random.Random(1)
    for _ in range(300):
        cuts = [sorted(random_.sample(range(1, 30), random_.randrange(1, 9))) + [30] for _ in range(2)]
        sizes = [[e - s for s, e in zip([0, *c], c)] for c in cuts]
        ids = [list(range(len(s))) for s in sizes]
        groups, links = alignment.align_ids(ids[0], ids[1], np.array(sizes[0]), np.array(sizes[1]), alignment._Spelled())
        spans = [list(zip([0, *c], c)) for c in cuts]
        plain = {(x << 32 | y) for x, (s, e) in enumerate(spans[0]) for y, (u, v) in enumerate(spans[1]) if s < v and u < e}
        assert set(links.tolist()) == plain and len(links) == len(plain) == len(ids[0]) + len(ids[1]) - len(groups)
        for k, side in enumerate(cuts):
            last = [int(g.split("|")[k].split(",")[-1]) for g in groups]
            assert last == [side.index(c) for c in cuts[0] if c in cuts[1]]
            assert [int(i) for g in groups for i in g.split("|")[k].split(",")] == ids[k]


def test_ids_of_the_first_vocabulary_equal_the_library():
    """Every code point beside letters, digits, marks and spaces; long runs; contractions."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    texts = [f" a{c}b {c}{c}1{c} {c}!{c}  {c}" for c in points]
    texts += [" " * 300_000 + "x", "\n\t " * 900, "a" * 50_000, "it's I'LL they'd've '' 's", *ODD_TEXTS, "<|endoftext|> x", "👍🏽" * 999]
    encode, spelled = alignment.byte_level_coder(PATHS[0])
    assert encode.__name__ == "encode_quickly"
    for start in range(0, len(texts), 5000):
        part = texts[start:start + 5000]
        found = encode(part)
        assert found == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert all(b"".join(spelled[i] for i in ids) == t.encode() for ids, t in zip(found, part))


def test_alignment_of_odd_rows(odd, nothing):
    rows = alignment.align(odd, *PATHS, keep_groups=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    assert {r["n_a"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert len({str(r) for r in rows if r["doc_id"] == 5}) == 1
    assert alignment.align(nothing, *PATHS).collect() == []


# Language


def _plain_length(text, trained):
    """Code length of a text by the definition, context by context."""
    def coded(t):
        return b"    " + re.sub(rb" +", b" ", t.lower().encode().translate(language_id._FOLD)).strip(b" ") + b" "

    follows = {}
    for t in trained:
        data = coded(t)
        for i in range(4, len(data)):
            for k in range(5):
                follows.setdefault(data[i - k:i], Counter())[data[i]] += 1
    bits, data = 0.0, coded(text)
    for i in range(4, len(data)):
        for k in range(4, -2, -1):
            if k < 0:
                bits += 8
                break
            after = follows.get(data[i - k:i])
            if after is None:
                continue
            n, d = after.total(), len(after)
            if after[data[i]]:
                bits -= math.log2(after[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
    return bits


def test_code_lengths_equal_the_definition(documents):
    random_ = random.Random(4)
    teach = {
        "x": [" ".join(random_.choice(["ab", "ba", "Übe", "cab"]) for _ in range(30)) for _ in range(6)],
        "y": [" ".join(random_.choice(["ac", "ca", "über", "bac"]) for _ in range(30)) for _ in range(6)],
    }
    rows = [(i, t, None) for i, t in enumerate(t for texts in teach.values() for t in texts)]
    table = documents(rows).withColumn("lang", F.when(F.col("doc_id") < 6, "x").otherwise("y"))
    model = language_id.train(table)
    assert model.languages == ["x", "y"]
    texts = ["ab ba cab", "ac über bac", "zzz", "Ü1!! ab", "", "日本", "ab " * 3000]
    found = language_id.code_lengths([t.lower().encode() for t in texts], model)
    for row, text in zip(found, texts):
        for bits, lang in zip(row, "xy"):
            assert bits == pytest.approx(_plain_length(text, teach[lang]), rel=1e-5, abs=1e-3)


def test_pieces_of_long_texts_are_coded_alike(documents):
    model = language_id.train(documents([(1, "aba caba daba " * 50, None), (2, "abc abd " * 9, None)]))
    texts = [b"aba dac" * 400, b"x", b"", b"caba " * 90]
    whole = language_id.code_lengths(texts, model)
    pieces, total = language_id._pieces, 0
    for limit in (16, 100, 1000):
        runs = list(pieces(texts, limit))
        bits = sum((sum(language_id.code_bits(r[o == 0], model)) for r, o in runs))
        assert bits == pytest.approx(whole[0])
        total += len(runs)
    assert total > 100


def test_language_on_held_out_documents(spark, base):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = QUERIES["op12_language_id"](spark, base).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] is not None]
    assert held and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) >= 0.98


def test_rare_followers_are_left_out_by_count(documents):
    table = documents([(i, "some words of a text " * (i + 1) + "q" * i, None) for i in range(12)])
    whole, small = language_id.train(table), language_id.train(table, nodes=60)
    for all_, few in zip(whole.levels, small.levels):
        assert len(few.followers) <= 12 and set(few.followers) <= set(all_.followers)
    assert language_id.predict(table, small).where("lang_pred = 'en'").count() == 12


def test_language_of_odd_rows(odd, nothing):
    model = language_id.train(odd)
    rows = language_id.predict(odd.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "lang_pred"}
    for r in rows:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if letter else "und") and r["score"] == (1.0 if letter else 0.0)
    empty = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(nothing, model).collect() == []


def test_no_language_is_left_out(documents, monkeypatch):
    """More languages than share a table are learned and predicted as by one table."""
    words = ["abc", "ghi", "mno", "stu", "xyz"]
    table = documents([(i, f"{words[i % 5]} " * (3 + i), None) for i in range(10)]).withColumn(
        "lang", F.concat(F.lit("l"), (F.col("doc_id") % 5).cast("string"))
    )
    told = lambda model: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(table, model).collect())
    whole = told(language_id.train(table))
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    model = language_id.train(table)
    assert model.languages == ["l0", "l1", "l2", "l3", "l4"] and len(model.others) == 2
    found = told(model)
    assert [r[:2] for r in found] == [(i, f"l{i % 5}") for i in range(10)]
    assert found == [(i, lang, pytest.approx(score)) for i, lang, score in whole]


# Resampling


def _plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain_draw(rows, target, percent=10, least_words=20, longest=1, buckets=10_000, seed=2024):
    def features(text):
        words = _plain_words(text)
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    out = []
    for doc_id, text in rows:
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
            for b in features(text)
        )
        if doc_id is None:
            out.append([None, len(features(text)), weight, None, None, 0])
            continue
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features(text)), weight, score, None, len(_plain_words(text))])
    fit = sorted((r for r in out if r[5] >= least_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 997, 35), (3, 50, 100)])
def test_draw_equals_the_definition(spark, base, documents, longest, buckets, percent):
    texts = _given_texts(spark, base, 120) + [t for t in ODD_TEXTS] + ["", None, "Ab\x00aB a-b AB", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    target = [r["text"] for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()] + [None]
    table = documents([(i, t, "a") for i, t in rows]).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.rank_documents(table, wanted, percent, 20, longest, buckets, 7)
    plain = _plain_draw(rows, target, percent, 20, longest, buckets, 7)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain
    drawn = {r[0] for r in plain if r[4] is not None}
    kept = resampling.resample(table, wanted, percent=percent, longest=longest, buckets=buckets, seed=7)
    assert {r["doc_id"] for r in kept.collect()} == drawn and kept.columns == table.columns


def test_resampling_of_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([("one two",)], "text string")
    for wanted in (target, target.where("false")):
        rows = resampling.rank_documents(odd, wanted, percent=100, least_words=1).collect()
        assert len(rows) == odd.count()
        assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r["rank"] is not None for r in rows)))
        assert all(r["rank"] is None for r in rows if r["doc_id"] in (None, 1, 2, 3))
    assert resampling.rank_documents(nothing, target).collect() == []
