"""Exact search of texts by texts: cosine of word counts, by an inverted index with bounds.

A text counts as its bag of words; texts of one bag are searched once. Words are ordered by how many bags of the
corpus hold them, the rarest first. What the words of a bag from some place on can add to a cosine is at most the
length of that part of its vector; the words before the place where this falls below the threshold are its prefix.
The first word that two similar bags share is in both prefixes, so only prefixes are joined, and frequent words are
hardly ever in one. Words are counted and ordered row by row: a text is shuffled once with its id and once as a
bag, and no word by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import claim_sentence
from colloquy.operators.ordered import first_rows
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan, keyed_block_join, same_key
from colloquy.session import bound_batches, materialize

#: Columns of a block that are multiplied at a time.
COLUMNS = 1024
#: Digits of a similarity; beyond them the order of additions would decide ties.
DIGITS = 12
#: The most frequent words, whose order every task knows, and how long such a word may be. All others count as rare.
FREQUENT, FREQUENT_LENGTH = 16_384, 64
#: Bytes of query words up to which the corpus is asked for them before it is moved.
ASKED_BYTES = 4 << 20
#: Places of a prefix that rounding may add, never take away.
_SLACK = 1e-6


def bags(texts: DataFrame) -> DataFrame:
    """(id, bag) of (id, text): the lower-case words between white space in order, of all texts of an id."""
    told = texts.groupBy("id").agg(F.array_join(F.collect_list(F.lower("text")), " ").alias("text"))
    words = F.array_sort(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return told.select("id", F.array_join(words, " ").alias("bag")).where("bag <> ''")


def frequent_words(corpus: DataFrame) -> dict[str, int]:
    """The words that most bags of (id, bag) hold, with the number of bags; at most FREQUENT of them."""
    words = corpus.select(F.explode(F.array_distinct(F.split("bag", " "))).alias("term"))
    counted = words.where(F.length("term") <= FREQUENT_LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return {r["term"]: r["n"] for r in counted.orderBy(F.desc("n"), "term").limit(FREQUENT).collect()}


def _indexed(rows: DataFrame, frequent: dict[str, int], min_similarity: float) -> DataFrame:
    """One row per bag of (id, bag) and prefix word: (id, key, terms, weights)."""
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words = pc.split_pattern(batch.column("bag").cast(pa.string()), " ")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(words).to_numpy())
            coded = words.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            place = np.empty(len(names), dtype=np.int64)
            place[sorted(range(len(names)), key=lambda k: (shared.value.get(names[k], 0), names[k]))] = np.arange(len(names))
            pairs, count = np.unique(row * len(names) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pairs, len(names))
            order = np.lexsort((place[code], row))
            row, code, count = row[order], code[order], count[order]
            weight = count / np.sqrt(np.bincount(row, weights=count**2.0))[row]
            ends = np.cumsum(np.bincount(row))
            upto = np.cumsum(weight**2)
            # What the words from each place on add up to.
            rest = np.sqrt(np.maximum(upto[ends - 1][row] - upto + weight**2, 0.0))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code))),
                pa.ListArray.from_arrays(offsets, pa.array(weight)),
                pa.array(np.bincount(row, weights=rest >= min_similarity - _SLACK).astype(np.int32)),
            ], names=["id", "terms", "weights", "leads"])

    kind = rows.schema["id"].dataType.simpleString()
    weighed = rows.select("id", "bag").mapInArrow(weigh, f"id {kind}, terms array<string>, weights array<double>, leads int")
    return weighed.select("id", F.explode(F.slice("terms", F.lit(1), F.col("leads"))).alias("key"), "terms", "weights")


def sparse_products(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Dot products of two blocks of sparse rows (terms, weights)."""
    sides = [
        pd.DataFrame({
            "row": np.repeat(np.arange(len(side)), side["terms"].map(len)),
            "term": np.concatenate(side["terms"].to_list()), "weight": np.concatenate(side["weights"].to_list()),
        })
        for side in (left, right)
    ]
    shared = np.intersect1d(sides[0]["term"].unique(), sides[1]["term"].unique())
    out = np.zeros((len(left), len(right)))
    for start in range(0, len(shared), COLUMNS):
        columns = pd.Index(shared[start:start + COLUMNS])
        dense = []
        for side, rows in zip(sides, out.shape):
            at = columns.get_indexer(side["term"])
            matrix = np.zeros((rows, len(columns)))
            matrix[side["row"].to_numpy()[at >= 0], at[at >= 0]] = side["weight"].to_numpy()[at >= 0]
            dense.append(matrix)
        out += dense[0] @ dense[1].T
    return np.round(out, DIGITS)


def search_texts(
    corpus: DataFrame, queries: DataFrame, limit: int = 10, min_similarity: float = 0.5, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """The most similar corpus texts of each query text: (query_id, match_id, similarity, rank).

    Both sides are (id, text); the threshold is above 0. Similarities are rounded to DIGITS digits, ties go to
    the smaller id. Null and empty texts match nothing. Each block hands on at most `limit` rows per query.
    """
    if min_similarity <= 0:
        raise ValueError("a threshold above 0 is needed: texts without a shared word have similarity 0")
    # Of a bag only its first ids can be among the best; the very first stands for it.
    held = materialize(first_rows(bags(corpus), ["bag"], [F.asc("id")], limit, "place").select("id", "bag", "place"))
    asked = materialize(bags(queries))
    reps = held.where("place = 1").select("id", "bag")
    frequent = frequent_words(reps)
    lefts = materialize(_indexed(asked.select(F.col("bag").alias("id"), "bag").distinct(), frequent, min_similarity))
    rights = _indexed(reps, frequent, min_similarity)
    keys = lefts.select("key").distinct()
    if (keys.agg(F.sum(F.octet_length("key") + 16).alias("n")).head()["n"] or 0) <= ASKED_BYTES:
        rights = rights.join(F.broadcast(keys), "key", "left_semi").select("id", "key", "terms", "weights")
    rights = materialize(rights)

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        keep = same_key(lpdf, rpdf) & (dots >= min_similarity)
        i, j = np.nonzero(keep)
        found = pd.DataFrame({"query_id": lpdf["id"].to_numpy()[i], "match_id": rpdf["id"].to_numpy()[j], "similarity": dots[i, j]})
        # Two texts may share several prefix words.
        found = found.drop_duplicates(["query_id", "match_id"])
        found = found.sort_values(["query_id", "similarity", "match_id"], ascending=[True, False, True])
        return found.groupby("query_id", sort=False).head(limit)

    schema = f"query_id string, match_id {rights.schema['id'].dataType.simpleString()}, similarity double"
    found = keyed_block_join(lefts, rights, block, schema, plan, sparse_products).dropDuplicates(["query_id", "match_id"])
    found = materialize(first_rows(found, ["query_id"], [F.desc("similarity"), F.asc("match_id")], limit).drop("rank"))
    # From bags to their first ids, and to all who ask for a bag.
    matched = found.join(reps.select(F.col("id").alias("rep_id"), "bag"), F.col("match_id").eqNullSafe(F.col("rep_id")))
    every = matched.select("query_id", "bag", "similarity").join(held.select("bag", F.col("id").alias("match_id")), "bag")
    best = first_rows(every.drop("bag"), ["query_id"], [F.desc("similarity"), F.asc("match_id")], limit)
    return best.withColumnRenamed("query_id", "bag").join(asked.withColumnRenamed("id", "query_id"), "bag").select(
        "query_id", "match_id", "similarity", "rank"
    )


def search_claims_by_text(
    claims: DataFrame, queries: DataFrame, limit: int = 10, min_similarity: float = 0.5, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """Canonical claims by query texts (query_id, text): (query_id, claim_id, similarity, rank)."""
    sentences = claims.where("is_canonical").select(
        F.col("claim_id").alias("id"), claim_sentence("subject", "predicate", "object").alias("text")
    )
    found = search_texts(sentences, queries.select(F.col("query_id").alias("id"), "text"), limit, min_similarity, plan)
    return found.withColumnRenamed("match_id", "claim_id")
