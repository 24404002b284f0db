"""License scan: an exact containment join of text blocks with notice templates.

Template words are ordered by how many blocks of the whole corpus hold them, rarest first. A block that
holds at least `threshold` of a template's distinct words must hold one of its rarest few (prefix
filter), must be long enough (length filter), and from the first shared word on both sides must have
enough words left (positional filter). What passes is verified on the full sets, so the join is exact.
Blocks are the lines of a text and, where it has several, windows over the words of all lines, so that
wrapped notices are found; lines and texts are cut into windows of WINDOW words every STEP words. So
every run of STEP words of the text lies within one block.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, utf8

WINDOW, STEP = 128, 64
THRESHOLD = 0.8

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wordings of common notices, at most STEP words each.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "Copyright the authors. All rights reserved. No part of this work may be reproduced without written permission"),
]

# Bytes of the word pattern `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; line ends stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 10 if b == 10 else 32
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return utf8(text).translate(_TABLE).split()


class NoticeIndex:
    """Prefix index over the templates for one global word order."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, frequency: dict[bytes, int]) -> None:
        self.threshold = threshold
        self.labels = [label for label, _ in templates]
        self.rank = {}
        sets = [set(words_of(text)) for _, text in templates]
        for w in sorted(set().union(*sets), key=lambda w: (frequency.get(w, 0), w)):
            self.rank[w] = len(self.rank)
        self.sets = [frozenset(s) for s in sets]
        self.ordered = [sorted(s, key=self.rank.__getitem__) for s in sets]
        self.needed = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.ordered):
            for i, w in enumerate(words[: len(words) - self.needed[t] + 1]):
                self.prefix.setdefault(w, []).append((t, i))

    def matches(self, block: list[bytes]) -> Iterator[tuple[int, float]]:
        """Templates that the block contains to the threshold, each once."""
        own = {w for w in block if w in self.rank}
        ordered = sorted(own, key=self.rank.__getitem__)
        met: set[int] = set()
        for j, w in enumerate(ordered):
            for t, i in self.prefix.get(w, ()):
                if t in met or len(own) < self.needed[t]:
                    continue
                met.add(t)  # the first shared word: nothing before it is shared
                if 1 + min(len(self.ordered[t]) - i, len(ordered) - j) - 1 < self.needed[t]:
                    continue
                shared = len(self.sets[t] & own)
                if shared >= self.needed[t]:
                    yield t, shared / len(self.sets[t])


def _blocks(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    if len(words) <= WINDOW:
        yield 0, words
        return
    for start in range(0, len(words) - WINDOW + STEP, STEP):
        yield start, words[start:start + WINDOW]


def _lines(text: str | None) -> list[list[bytes]]:
    return [line.split() for line in utf8(text).translate(_TABLE).split(b"\n")]


def _across(lines: list[list[bytes]]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks over the words of all lines, where more than one line has any."""
    if sum(map(bool, lines)) > 1:
        yield from _blocks([word for line in lines for word in line])


class _Held:
    """Which line blocks hold which template, by their first words in ascending order."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = defaultdict(list)
        self.rest: dict[int, list[tuple[int, float]]] = defaultdict(list)

    def add(self, t: int, start: int, end: int, share: float) -> None:
        self.starts[t].append(start)
        self.rest[t].append((end, share))

    def as_much(self, t: int, start: int, end: int, share: float) -> bool:
        """Whether a line block that meets start to end holds as much of the template."""
        starts = self.starts.get(t)
        if not starts:
            return False
        # No block is longer than WINDOW, so few of them can meet one.
        near = self.rest[t][bisect_right(starts, start - WINDOW):bisect_left(starts, end)]
        return any(upto > start and part >= share for upto, part in near)


def block_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many blocks of the lines of all texts each vocabulary word stands (one row per word comes back)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for line in _lines(text):
                    if not vocabulary.isdisjoint(line):
                        for _, block in _blocks(line):
                            total.update(vocabulary.intersection(block))
        if total:
            yield pd.DataFrame({"word": [w.decode() for w in total], "n": list(total.values())})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "word string, n long")
    return {r["word"].encode(): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Adds n_words, places (phrase label and first word of each phrase) and notices.

    `notices` lists label, containment and first word of each matching block and template, by first word;
    a block across lines is left out if a line block that it meets holds as much of the template. Words are
    counted from 0. Null and empty texts have no words and empty lists. Equal rows give equal rows; an
    empty table gives none. Existing columns of these names are replaced, all others stay. No row is
    shuffled; one row per template word reaches the driver.
    """
    bound_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    if any(len(words_of(text)) > STEP for _, text in templates):
        raise ValueError(f"a template has more than {STEP} words")
    vocabulary = set().union(*(words_of(text) for _, text in templates))
    index = NoticeIndex(templates, threshold, block_frequencies(docs, vocabulary))
    rare = set(index.prefix)
    phrase = re.compile(
        b"(?<![^ ])(" + b"|".join(p.encode().replace(b" ", b" +") for p in PHRASES) + b")(?![^ ])"
    )
    quick = re.compile(b"license|cc +by")
    label_of = {p.encode(): label for p, label in PHRASES.items()}

    kinds = (
        "n_words long, place_labels array<string>, place_starts array<long>, "
        "labels array<string>, shares array<double>, starts array<long>"
    )

    @F.pandas_udf(kinds)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                data = utf8(text).translate(_TABLE)
                lines = [line.split() for line in data.split(b"\n")]
                at, notices, held, hints = 0, [], _Held(), False
                for words in lines:
                    if not rare.isdisjoint(words):
                        hints = True
                        for start, block in _blocks(words):
                            if not rare.isdisjoint(block):
                                for t, share in index.matches(block):
                                    notices.append((index.labels[t], share, at + start))
                                    held.add(t, at + start, at + start + len(block), share)
                    at += len(words)
                for start, block in _across(lines) if hints else ():
                    if not rare.isdisjoint(block):
                        for t, share in index.matches(block):
                            if not held.as_much(t, start, start + len(block), share):
                                notices.append((index.labels[t], share, start))
                notices.sort(key=lambda n: n[2])
                places = []
                flat = data.replace(b"\n", b" ")
                if quick.search(flat):
                    counted, done = 0, 0
                    for found in phrase.finditer(flat):
                        counted += len(flat[done:found.start()].split())
                        done = found.start()
                        places.append((label_of[b" ".join(found.group().split())], counted))
                rows.append((
                    at, [p[0] for p in places], [p[1] for p in places],
                    [n[0] for n in notices], [n[1] for n in notices], [n[2] for n in notices],
                ))
            yield pd.DataFrame(rows, columns=[k.split()[0] for k in kinds.split(", ")])

    scanned = docs.withColumn("_scan", scan(F.col("text").cast("string")))
    places = F.arrays_zip(F.col("_scan.place_labels").alias("label"), F.col("_scan.place_starts").alias("start"))
    notices = F.arrays_zip(
        F.col("_scan.labels").alias("label"), F.col("_scan.shares").alias("containment"), F.col("_scan.starts").alias("start")
    )
    return (
        scanned.withColumn("n_words", F.col("_scan.n_words")).withColumn("places", places).withColumn("notices", notices)
        .drop("_scan")
    )
