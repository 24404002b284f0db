"""Discussion signals of one text as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from colloquy import vocab
from colloquy.functions.text import contains_any


def _camp_word(pattern: str) -> str:
    """The literal a camp pattern starts with."""
    return re.match(r"[a-z]+", pattern)[0].removesuffix("s" if "s?" in pattern else "\0")


#: Words that one scan of Arrow looks for at once; only texts with one of them are asked for each word.
_GROUP = 11


def _lowered(text: bytes) -> bytes:
    """Lower case as far as ASCII words can tell: two other letters have a lower case that begins with one."""
    low = text.lower()
    return low if low.isascii() else low.replace(b"\xe2\x84\xaa", b"k").replace(b"\xc4\xb0", b"i\xcc\x87")


@cache
def _searches() -> list[tuple[str, list[tuple[bytes, int, Callable | None]]]]:
    """Groups of words with the pattern that finds any of them: (word, bit, regex that must match as well)."""
    camps = [(_camp_word(p).encode(), re.compile(p.encode(), re.IGNORECASE).search) for p, _ in vocab.CAMP_PATTERNS]
    words = [
        *((k.encode(), 1 << i, None) for i, k in enumerate(vocab.CONTROVERSY_KEYWORDS)),
        *((word, 1 << _CAMPS + i, search) for i, (word, search) in enumerate(camps)),
        *((w.encode(), 1 << _POSITIVE, None) for w in vocab.POSITIVE_WORDS),
        *((w.encode(), 1 << _NEGATIVE, None) for w in vocab.NEGATIVE_WORDS),
    ]
    groups = [words[i:i + _GROUP] for i in range(0, len(words), _GROUP)]
    return [("|".join(re.escape(word.decode()) for word, _, _ in group), group) for group in groups]


_CAMPS = len(vocab.CONTROVERSY_KEYWORDS)
_POSITIVE = _CAMPS + len(vocab.CAMP_PATTERNS)
_NEGATIVE = _POSITIVE + 1


@F.arrow_udf(LongType())
def _found_in(texts: pa.Array) -> pa.Array:
    raw = [t or b"" for t in texts.to_pylist()]
    lowered = [_lowered(t) for t in raw]
    table, found = pa.array(lowered, pa.large_binary()), [0] * len(raw)
    for pattern, group in _searches():
        for i in np.flatnonzero(pc.match_substring_regex(table, pattern).to_numpy(zero_copy_only=False)):
            for word, bit, search in group:
                if word in lowered[i] and (search is None or search(raw[i])):
                    found[i] |= bit
    return pa.array(found, pa.int64())


def text_signals(text: Column) -> Column:
    """All signals of one text as bits: `keyword_mask`, `camp_mask`, `is_positive_text`, `is_negative_text` read them.

    The text is gone over a few times, not once for every word; the cases of letters are ASCII's. Null has no signals.
    `bit_or` unites the texts of a post.
    """
    return _found_in(text.cast("binary"))


def _bits(signals: Column, first: int, stop: int) -> Column:
    return F.shiftright(signals, first).bitwiseAND(F.lit((1 << stop - first) - 1))


def keyword_mask(signals: Column) -> Column:
    """Bit i is set when controversy keyword i occurs."""
    return _bits(signals, 0, _CAMPS)


def camp_mask(signals: Column) -> Column:
    """Bit i is set when camp pattern i matches."""
    return _bits(signals, _CAMPS, _POSITIVE)


def is_positive_text(signals: Column) -> Column:
    return _bits(signals, _POSITIVE, _NEGATIVE) != 0


def is_negative_text(signals: Column) -> Column:
    return _bits(signals, _NEGATIVE, _NEGATIVE + 1) != 0


def mask_names(mask: Column, names: list[str]) -> Column:
    """Names of the set bits in list order."""
    picked = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(names)]
    return F.array_compact(F.array(*picked))


def keyword_names(mask: Column) -> Column:
    return mask_names(mask, vocab.CONTROVERSY_KEYWORDS)


def camp_names(mask: Column) -> Column:
    return mask_names(mask, [camp for _, camp in vocab.CAMP_PATTERNS])


def is_positive(lowered: Column) -> Column:
    return contains_any(lowered, vocab.POSITIVE_WORDS)


def is_negative(lowered: Column) -> Column:
    return contains_any(lowered, vocab.NEGATIVE_WORDS)


def has_controversial_words(lowered: Column) -> Column:
    return contains_any(lowered, vocab.COMMENT_FLAG_KEYWORDS)
