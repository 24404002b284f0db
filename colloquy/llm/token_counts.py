"""Token counts by prefix dynamic programming over a BPE vocabulary with word ends.

In a BPE encoding every two neighbours are what the pair's own text encodes to, and only one token
sequence of a text has that property. So the last token of a prefix follows from the last tokens of
shorter prefixes: it is the token t ending there that stands well after the last token of what is
left of t. One table of (last token, count) over all prefixes of a word therefore answers how many
tokens any prefix has, and a text needs one such table per word.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches

END = "</w>"
#: Beyond these characters (or at a dotted capital I) normal forms need care.
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
SPACE = r"\t-\r \x85\xa0  -     　"
#: Entries of a worker's word and prefix tables; a full table is emptied, results do not change.
TABLE_ENTRIES = 300_000


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class PrefixCounter:
    """Counts of every prefix of a word, and of whole texts, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.special = {t["content"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.full_normalize: Callable[[str], str] = Tokenizer.from_file(path).normalizer.normalize_str
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.letters = _byte_letters()
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[str, int]] = {}
        self.counts: dict[str, int] = {}

    def normalize(self, text: str) -> str:
        """The vocabulary's normal form, up to the amount of white space, which is no part of a word.

        Latin text without combining marks is composed already, and its letters have one lower-case
        form each, so lower() does; all other text goes through the library's normaliser.
        """
        return text.lower() if BEYOND_LATIN.search(text) is None else self.full_normalize(text)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain merging of a short sequence; used for single pairs of tokens only."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stands_after(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            body = right.removesuffix(END) if len(right) > len(END) else right
            symbols = [*left, *body]
            if body != right:
                symbols[-1] += END
            known = self._merged(symbols) == [left, right]
            if len(self.fits) >= TABLE_ENTRIES:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _last(self, word: str, end: str) -> tuple[str, int]:
        """Last token and number of tokens of word + end, given those of its proper prefixes."""
        for start in range(max(0, len(word) - self.longest), len(word)):
            token = word[start:] + end
            if token not in self.vocab:
                continue
            if start == 0:
                if len(word) == 1 or self._single(word, token):
                    return token, 1
                continue
            before, count = self._prefix(word[:start])
            if self._stands_after(before, token):
                return token, count + 1
        raise ValueError(f"no token sequence for {word!r}")

    def _single(self, word: str, token: str) -> bool:
        known = self.fits.get(("", token))
        if known is None:
            symbols = [*word]
            if token != word:
                symbols[-1] += END
            known = self._merged(symbols) == [token]
            self.fits["", token] = known
        return known

    def _prefix(self, prefix: str) -> tuple[str, int]:
        known = self.prefixes.get(prefix)
        if known is not None:
            return known
        # Shorter prefixes first: no recursion, however long the word is.
        cut = len(prefix) - 1
        while cut > 0 and prefix[:cut] not in self.prefixes:
            cut -= 1
        if len(self.prefixes) + len(prefix) >= TABLE_ENTRIES:
            self.prefixes.clear()
            cut = 0
        for length in range(cut + 1, len(prefix) + 1):
            self.prefixes[prefix[:length]] = self._last(prefix[:length], "")
        return self.prefixes[prefix]

    def _rows(self, letters: str, end_of: Callable[[int], bool]) -> list[int]:
        """Counts of all prefixes of a long word, by a table of its own (linear memory)."""
        last: list[str] = [""]
        counts = [0]
        closed = []
        for i in range(1, len(letters) + 1):
            for end in ("", END) if end_of(i) else ("",):
                for start in range(max(0, i - self.longest), i):
                    token = letters[start:i] + end
                    if token in self.vocab and (
                        self._single(letters[:i], token) if start == 0 else self._stands_after(last[start], token)
                    ):
                        break
                if end:
                    closed.append(counts[start] + 1)
                else:
                    last.append(token)
                    counts.append(counts[start] + 1)
        return closed

    def word(self, word: str) -> int:
        """Number of tokens of a word."""
        count = self.counts.get(word)
        if count is None:
            letters = "".join(self.letters[b] for b in word.encode("utf-8"))
            if len(letters) > 64:
                return self._rows(letters, lambda i: i == len(letters))[-1]
            count = self._last(letters, END)[1]
            if len(self.counts) >= 2 * TABLE_ENTRIES:
                self.counts.clear()
            self.counts[word] = count
        return count

    def word_prefixes(self, word: str) -> list[int]:
        """Number of tokens of every prefix of a word, by code points, each as a word of its own."""
        letters = "".join(self.letters[b] for b in word.encode("utf-8"))
        ends, at = set(), 0
        for char in word:
            at += len(char.encode("utf-8"))
            ends.add(at)
        return self._rows(letters, ends.__contains__)

    def parts(self, text: str) -> Iterator[str | None]:
        """Normalised text between special tokens; None for a special token."""
        if self.split is None or "<" not in text:
            yield text
            return
        at = 0
        for found in self.split.finditer(text):
            if found.start() > at:
                yield text[at:found.start()]
            yield None
            at = found.end()
        if at < len(text):
            yield text[at:]

    def text(self, text: str) -> int:
        """Number of tokens of a whole text."""
        total, counts, count_word = 0, self.counts, self.word
        for part in self.parts(text):
            if part is None:
                total += 1
                continue
            for word in self.words.findall(self.normalize(part)):
                count = counts.get(word)
                total += count_word(word) if count is None else count
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a normalised text: entry i belongs to its first i code points.

        The text must be its own normal form and hold no special token (a prefix of such a text is
        normal too); `store_prefix_counts` sees to that.
        """
        out = np.zeros(len(text) + 1, dtype=np.int32)
        total, at = 0, 0
        for found in self.words.finditer(text):
            start, end = found.span()
            out[at:start + 1] = total
            word = found.group()
            rows = self._closed_prefixes(word)
            out[start + 1:end + 1] = total + np.asarray(rows, dtype=np.int32)
            total += rows[-1]
            at = end
        out[at:] = total
        out[-1] = total
        return out

    def _closed_prefixes(self, word: str) -> list[int]:
        if word[0] != "'" or len(word) == 1 or not word[1].isalpha():
            return self.word_prefixes(word)
        # A cut contraction falls apart into an apostrophe and letters.
        out = []
        for i in range(1, len(word) + 1):
            out.append(sum(self.word(w) for w in self.words.findall(word[:i])))
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text.

    `vocabulary` is the path of a BPE file that every executor has. A null text counts as empty, 0
    tokens. Special strings inside a text are one token each. Other columns stay as they are; an
    existing column called `name` is replaced. No shuffle; memory is bounded by the batch and tables
    of TABLE_ENTRIES words.
    """

    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for batch in batches:
            yield pd.Series([own.text(t) if t else 0 for t in batch], dtype="int64")

    return docs.withColumn(name, count(F.col(text)))


def store_prefix_counts(docs: DataFrame, vocabulary: str, text: str = "text", name: str = "prefix_counts") -> DataFrame:
    """Replaces the text by its normal form and adds the packed counts of all its prefixes.

    The counts (32-bit, one per code point and one for the empty prefix) are packed by zlib; special
    strings count as ordinary characters here, since cutting one makes it ordinary. `count_at` and
    `longest_within` answer questions from the packed column without encoding anything again.
    """

    bound_batches(docs.sparkSession)

    @F.pandas_udf("text string, counts binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary)
        for batch in batches:
            normal = [own.full_normalize(t) if t else "" for t in batch]
            packed = [zlib.compress(own.prefix_counts(t).tobytes(), 1) for t in normal]
            yield pd.DataFrame({"text": normal, "counts": packed})

    built = docs.withColumn("_built", build(F.col(text)))
    return built.withColumn(text, F.col("_built.text")).withColumn(name, F.col("_built.counts")).drop("_built")


def count_at(packed, at):
    """Column: tokens of the first `at` code points of a stored text."""

    @F.pandas_udf("long")
    def look(counts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for blob, end in zip(counts, ends):
            row = np.frombuffer(zlib.decompress(blob), dtype=np.int32)
            out.append(int(row[min(max(int(end), 0), len(row) - 1)]))
        return pd.Series(out, dtype="int64")

    return look(packed, at)


def longest_within(packed, budget):
    """Column: code points of the longest prefix of a stored text that has at most `budget` tokens."""

    @F.pandas_udf("long")
    def look(counts: pd.Series, budgets: pd.Series) -> pd.Series:
        out = []
        for blob, most in zip(counts, budgets):
            row = np.frombuffer(zlib.decompress(blob), dtype=np.int32)
            out.append(int(np.flatnonzero(row <= int(most))[-1]) if int(most) >= 0 else 0)
        return pd.Series(out, dtype="int64")

    return look(packed, budget)
