"""Importance resampling towards a target distribution, with Arrow kernels.

Texts are lower-cased, split into words and flattened by Arrow kernels; the dictionary of a batch gives
every word an index. Shifted indices, put side by side, are the n-grams of a length; only distinct ones are
written out and hashed (CRC-32) to buckets. Counts of buckets are added up over the corpus and over the
target; the log ratio of the smoothed shares is the gain of a bucket. A document's weight is the sum of the
gains of its features (taken by bucket, reduced by segments), and Gumbel noise keyed by its id turns the
highest scores into a draw without replacement.

Sizes: a task emits one count per bucket however many rows it reads, and the gains are one number per bucket,
so what is gathered on the driver is bounded by the number of buckets. Ranks come from one range shuffle of
narrow rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import CHUNK_BYTES, bound_batches, chunks
from colloquy.operators.ordered import row_numbers
from colloquy.session import materialize

#: What stands between the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts in a row, as a dictionary array, and the number of words of each text."""
    filled = pc.fill_null(texts, "")
    lists = pc.split_pattern_regex(pc.ascii_lower(filled), pattern=_BETWEEN)
    words = pc.list_flatten(lists)
    owners = pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    counts = np.bincount(owners.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return words.filter(real).dictionary_encode(), counts


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, the text each belongs to, and the number of words of each text.

    Features are the runs of 1 to `longest` words, joined by one space. Order is by length, then by place.
    """
    encoded, counts = word_lists(texts)
    places = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [word.encode("utf-8") for word in encoded.dictionary.to_pylist()]
    owner = np.repeat(np.arange(len(texts)), counts)
    found, owners = [], []
    runs, spelled = places, names
    for n in range(1, longest + 1):
        if n > 1:
            # Run of n words: the run of n-1 words that starts here and the word n-1 places on.
            inside = owner[: len(owner) - n + 1] == owner[n - 1:]
            pairs = runs[: len(inside)] * max(len(names), 1) + places[n - 1:]
            distinct = np.unique(pairs[inside])
            spelled = [spelled[p // len(names)] + b" " + names[p % len(names)] for p in distinct.tolist()]
            runs = np.where(inside, np.searchsorted(distinct, pairs), 0)
        else:
            inside = np.ones(len(places), dtype=bool)
        table = np.array([zlib.crc32(s) % buckets for s in spelled], dtype=np.int64)
        found.append(table[runs[inside]] if len(table) else np.zeros(0, dtype=np.int64))
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(found), np.concatenate(owners), counts


def _parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in chunks(sizes, limit):
        yield a, column.slice(a, b - a)


def bucket_counts(texts: DataFrame, column: str, longest: int, buckets: int) -> DataFrame:
    """How many features of all texts fall into each bucket: (bucket, n), buckets without any left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                total += np.bincount(feature_buckets(part, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    narrow = texts.select(F.col(column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int, text: str = "text") -> np.ndarray:
    """Gain of each bucket: floor(1000 * ln of the target's smoothed share over the corpus's)."""
    both = bucket_counts(docs, text, longest, buckets).withColumn("side", F.lit(0)).unionByName(
        bucket_counts(target, text, longest, buckets).withColumn("side", F.lit(1))
    )
    # Two numbers per bucket at most.
    rows = both.toPandas()
    seen = np.zeros((2, buckets), dtype=np.float64)
    seen[rows["side"].to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    (s, t), (total_s, total_t) = seen, seen.sum(axis=1)
    share = (t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; score is null where doc_id is."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in _parts(batch.column(1)):
                found, owners, words = feature_buckets(part, longest, buckets)
                features = np.bincount(owners, minlength=len(part))
                order = np.argsort(owners, kind="stable")
                ends = np.cumsum(features)
                sums = np.concatenate([[0], np.cumsum(gain[found[order]])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.array(words.astype(np.int64)),
                     pa.array(features.astype(np.int64)), pa.array(sums[ends] - sums[ends - features])],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    weighed = narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def rank_documents(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1,
    buckets: int = 10_000, seed: int = 2024, text: str = "text",
) -> DataFrame:
    """Every document with its weight, score and place in the draw: (doc_id, n_features, weight, score, rank).

    Of the N rows with at least `least_words` words the floor(percent * N / 100) highest scores are drawn, ties
    to smaller doc_id; rank is null for the others. A null or empty text has no features, weight 0, and is
    never drawn for lack of words (where least_words is above 0). A row without a doc_id has a weight, but no
    score, is not among the N and is not drawn. Rows that repeat a doc_id are documents of their own with one
    noise. An empty target or table has zero counts, which the smoothing allows. Only doc_id and `text` are
    read, so other columns may have any name.
    """
    bound_batches(docs.sparkSession)
    gain = gains(docs, target, longest, buckets, text)
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    weighed = materialize(weigh(docs, gain, longest, seed, text).withColumn("fit", fit))
    drawn = weighed.where("fit").count() * percent // 100
    # Rows that cannot be drawn stand behind all others, so one range shuffle serves both.
    order = [F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    ranked = row_numbers(weighed, [], order, "place")
    rank = F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place").cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """The drawn documents with all their columns; parameters as in `rank_documents`.

    Rows that repeat a doc_id stay or go together: they stay if any of them is drawn.
    """
    drawn = rank_documents(docs, target, text=text, **parameters).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")


SQL = r"""
WITH codes AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), codes),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000) / ((s.n + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
    ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) FROM z) * 10 // 100 THEN place END::BIGINT AS rank
FROM y LEFT JOIN z USING (doc_id)"""
