"""Alignment of two tokenizers by the byte offsets at which both end a token.

A dictionary leads from each cumulative end of the first tokenizer to the index behind its token; the ends of the
second are looked up in it, in their order. The ends both have slice both lists of ids into groups that spell the
same bytes. Within a slice the tokens whose bytes overlap are linked.

Counts of linked id pairs over all documents come from the written alignments. The most frequent pairs, up to
a fixed number, go to every task to look up links in place; links of rarer pairs meet their counts in a
shuffle. So what is broadcast is bounded whatever the corpus holds, and most links never move.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_ROWS, bound_batches, chunks
from colloquy.session import materialize

#: Bytes of text that are tokenized at a time.
TOKEN_BYTES = 1 << 18
_SHIFT = 32

# Fixed value: what the byte-level pre-tokenizer takes as one word.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space that its look-ahead may be too deep for; such texts go to the tokenizers library.
_LONG_GAP = re.compile(r"\s{1000}")

#: Ids of many texts, and the bytes of every id.
Coder = tuple[Callable[[list[str]], list[list[int]]], list[bytes]]


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes follow from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_level_coder(path: str) -> Coder:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    alphabet = byte_level_alphabet()
    quick = _quick_encoding(path, alphabet)
    entries = tokenizer.get_vocab(with_added_tokens=True)
    spelled = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        known = all(c in alphabet for c in entry)
        spelled[i] = bytes(alphabet[c] for c in entry) if known else entry.encode("utf-8")

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_quickly(texts: list[str]) -> list[list[int]]:
        return [encode([t])[0] if _LONG_GAP.search(t) else quick.encode_ordinary(t) for t in texts]

    return (encode if quick is None else encode_quickly), spelled


def _quick_encoding(path: str, alphabet: dict[str, int]):
    """The vocabulary as ranks for tiktoken, which gives the same ids in a quarter of the time.

    None where the file is more than byte-level merges in the order of their ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not usual or told.get("normalizer") or model.get("type", "BPE") != "BPE" or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in told.get("added_tokens", [])}
    entries = {e: i for e, i in model["vocab"].items() if e not in special}
    merged = [entries["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if not all(c in alphabet for e in entries for c in e) or merged != sorted(merged) or len(entries) != len(merged) + 256:
        return None
    ranks = {bytes(alphabet[c] for c in e): i for e, i in entries.items()}
    return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_coder(path: str) -> Coder:
    """A sentencepiece model; it adds the space in front of a text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    spelled = [
        bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode("utf-8")
        for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    ]
    return lambda texts: [model.encode(t) for t in texts], spelled


class _Ids(dict):
    """Decimal ids, as they are asked for; no more than a vocabulary has."""

    def __missing__(self, token: int) -> str:
        self[token] = shown = str(token)
        return shown


class _Spelled(dict):
    """`a|b` of id pairs (a << 32 | b), as they are asked for; forgotten beyond a number of pairs."""

    def __init__(self) -> None:
        super().__init__()
        self.ids = _Ids()

    def __missing__(self, pair: int) -> str:
        if len(self) >= BROADCAST_ROWS:
            self.clear()
        self[pair] = shown = f"{pair >> _SHIFT}|{pair & 0xFFFFFFFF}"
        return shown


def align_ids(
    a: np.ndarray | list[int], b: np.ndarray | list[int], sizes_a: np.ndarray, sizes_b: np.ndarray, names: _Spelled
) -> tuple[list[str], np.ndarray]:
    """Groups as `a1,a2|b1`, and the id pairs of all links (a << 32 | b).

    `sizes_a`, `sizes_b` give the bytes of every id, `names` spells pairs; both lists spell the same bytes.
    """
    of_a, of_b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    a, b = of_a.tolist(), of_b.tolist()
    ends_a, ends_b = np.cumsum(sizes_a[of_a]), np.cumsum(sizes_b[of_b])
    index_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1)))
    # Looked up in their order, the ends of the second need no sorting; of equal ends the last counts.
    behind = np.fromiter(map(index_a.get, ends_b.tolist(), repeat(0)), np.int64, len(b))
    to_b = np.flatnonzero((behind > 0) & np.append(ends_b[1:] != ends_b[:-1], True)[:len(b)]) + 1
    to_a = behind[to_b - 1]
    from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
    # The last tokens of a slice overlap. Every other end lies within one token of the other side: one link each.
    inner_a, inner_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    inner_a[to_a - 1] = inner_b[to_b - 1] = False
    inner_a, inner_b = np.flatnonzero(inner_a), np.flatnonzero(inner_b)
    links = of_a[to_a - 1] << _SHIFT | of_b[to_b - 1]
    groups = list(map(names.__getitem__, links.tolist()))
    # Most slices hold one token of either side. The others are spelled one by one.
    several = np.flatnonzero((to_a - from_a > 1) | (to_b - from_b > 1))
    shown = names.ids.__getitem__
    for at, i, k, j, m in zip(*(x.tolist() for x in (several, from_a[several], to_a[several], from_b[several], to_b[several]))):
        groups[at] = ",".join(map(shown, a[i:k])) + "|" + ",".join(map(shown, b[j:m]))
    return groups, np.concatenate([
        links,
        of_a[inner_a] << _SHIFT | of_b[np.searchsorted(ends_b, ends_a[inner_a])],
        of_a[np.searchsorted(ends_a, ends_b[inner_b])] << _SHIFT | of_b[inner_b],
    ])


_ALIGNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
])


def alignments(
    docs: DataFrame, byte_level_path: str, piece_path: str, text: str = "text", keep_groups: bool = True
) -> DataFrame:
    """Every row's alignment: row (unique), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times.

    `groups` (null unless kept) lists the ids of both tokenizers by group, `pairs` the different linked id
    pairs (id of the first << 32 | id of the second) and `times` how often each is linked. A text that is null or
    empty, or whose tokens of either side do not spell one space and the text, has no tokens: zeros, empty
    lists and ''. Whole texts of any length are aligned, in memory proportional to the longest. Only doc_id
    and `text` are read, so other columns may have any name.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, bytes_a = byte_level_coder(byte_level_path)
        encode_b, bytes_b = piece_coder(piece_path)
        sizes_a, sizes_b = np.array([len(s) for s in bytes_a]), np.array([len(s) for s in bytes_b])
        spelled_a, spelled_b = np.array(bytes_a, dtype=object), np.array(bytes_b, dtype=object)
        names = _Spelled()
        # The vocabularies stay as long as the worker; the collector need not walk them again and again.
        gc.freeze()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for start, stop in chunks([len(t) for t in texts], TOKEN_BYTES):
                part = texts[start:stop]
                rows, pairs, times, offsets = [], [], [], [0]
                for t, a, b in zip(part, encode_a([" " + t for t in part]), encode_b(part)):
                    whole = b" " + t.encode("utf-8")
                    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                    if t and whole == b"".join(spelled_a[a]) == b"".join(spelled_b[b]):
                        groups, links = align_ids(a, b, sizes_a, sizes_b, names)
                        shown = ";".join(groups)
                        digest = hashlib.sha256(shown.encode("ascii")).hexdigest()
                        rows.append((len(a), len(b), len(groups), len(links), digest, shown if keep_groups else None))
                        distinct, often = np.unique(links, return_counts=True)
                        pairs.append(distinct)
                        times.append(often)
                        offsets.append(offsets[-1] + len(distinct))
                    else:
                        rows.append((0, 0, 0, 0, "", "" if keep_groups else None))
                        offsets.append(offsets[-1])
                columns = list(zip(*rows))
                flat = np.concatenate([*pairs, np.zeros(0, dtype=np.int64)])
                often = np.concatenate([*times, np.zeros(0, dtype=np.int64)]).astype(np.int32)
                cuts = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start),
                    *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]],
                    pa.ListArray.from_arrays(cuts, pa.array(flat)), pa.ListArray.from_arrays(cuts, pa.array(often)),
                ], schema=_ALIGNED)

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )
    return narrow.mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "groups string, pairs array<long>, times array<int>",
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """In how many documents each id pair is linked: (pair, n, best); best: no pair of its first id has more."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted)
    # One row per id of the first vocabulary at most.
    highest = counted.groupBy(_first(F.col("pair")).alias("id")).agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(highest), _first(F.col("pair")) == F.col("id")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def _first(pair: Column) -> Column:
    return F.shiftright(pair, _SHIFT)


def _least_count(counts: DataFrame, rows: int) -> int:
    """The smallest power of two for which at most `rows` pairs have that count or more."""
    step = F.floor(F.log2("n")).cast("int")
    total = 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True):
        total += r["pairs"]
        if total > rows:
            return 1 << (r["step"] + 1)
    return 1


def link_scores(aligned: DataFrame, counts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of the alignments: (row, n_best, count_sum), over its links.

    `counts` are those of `pair_counts`; n_best counts links whose pair is best, count_sum adds up the counts.
    Rows without links are left out. At most `rows` pairs, the most frequent, are broadcast.
    """
    least = _least_count(counts, rows)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times")
    )
    at_hand = links.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    if least == 1:
        found = at_hand
    else:
        rare = at_hand.where("n is null").select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair")
        found = at_hand.where("n is not null").unionByName(rare)
    return found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )


def align(docs: DataFrame, byte_level_path: str, piece_path: str, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Alignments of all rows with the corpus-wide figures of their links.

    Columns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if kept, groups. Every row is a
    document of its own, also where rows repeat a doc_id or have none. An empty table gives no rows. See
    `alignments` for texts without tokens.
    """
    aligned = materialize(alignments(docs, byte_level_path, piece_path, text, keep_groups))
    counts = materialize(pair_counts(aligned))
    scores = link_scores(aligned, counts)
    zero = F.lit(0).cast("long")
    return aligned.join(scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if keep_groups else []),
    )
