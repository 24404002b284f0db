"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations.

Test items are partitioned by the size of their shingle sets. An item of n shingles that a document
contains to the threshold t lacks at most m = n - ceil(t*n) of them there, so of its m + 1 least values
under one MinHash permutation at least one stands in the document. Each partition therefore indexes
bottom sketches of its own length (m + 1 for its sizes), and looking up every shingle of every document
in the sketches finds all candidates, however long the document is. Candidates are verified by the
exact containment of shingles. Nothing is lost to chance: the sketch length is a bound, not a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import lower_ascii, small_side
from colloquy.session import materialize

WORDS = 5
THRESHOLD_PERCENT = 80
#: Everything but digits, letters and characters beyond ASCII parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, without punctuation."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def shingles(tokens: Column, size: int = WORDS) -> Column:
    """64-bit hashes of all runs of `size` words; of the whole text if it has fewer, none if it has none.

    The hash of a short text takes in its number of words, so it meets only texts of the same words.
    """
    def of(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(w) - size + 1),
            lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(size)]),
        )
        whole = F.array(F.xxhash64(F.size(w), F.array_join(w, " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < size, whole).otherwise(runs)

    # A lambda variable holds the words: an expression used in it would be computed for every run.
    return F.element_at(F.transform(F.array(tokens), of), 1)


def item_sketches(items: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Shingles of the items (item, n, shingle), and the rows among them that sketches index.

    `part` is the size partition (powers of two of n); `least` the sketch length of the item's size.
    """
    sets = (
        items.select("item_id", F.array_distinct(shingles(words(F.col("text").cast("string")), size)).alias("set"))
        .where(F.size("set") > 0)
        .withColumn("n", F.size("set"))
        .withColumn("part", F.floor(F.log2("n")))
        .withColumn("least", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    )
    # The MinHash order is a second hash of the shingle.
    ordered = F.array_sort(F.transform("set", lambda s: F.struct(F.xxhash64(s, F.lit(17)).alias("h"), s.alias("s"))))
    full = sets.select("item_id", "n", F.explode("set").alias("shingle"))
    index = sets.select("item_id", "n", "part", F.explode(F.slice(ordered, F.lit(1), F.col("least").cast("int"))).alias("x"))
    return full, index.select("item_id", "n", "part", F.col("x.s").alias("shingle"))


def find_items(
    docs: DataFrame, items: DataFrame, size: int = WORDS, percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """Which items stand in which texts: (text_key, item_id, n_item, n_shared).

    text_key is the md5 of the text, so equal texts are searched as one and rows need no id. A pair is
    returned if at least `percent` percent of the item's distinct shingles (`size` words) stand in the
    text. An item with fewer words is found only in texts that consist of the same words. Null and
    empty items are found nowhere; null and empty texts hold nothing. Items with the same item_id and
    different texts are searched as one item each by their text.
    """
    own_items = items.select(
        F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")
    ).withColumn("item_id", F.struct("id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))).dropDuplicates(["item_id"])
    full, index = item_sketches(own_items, size, percent)
    full = materialize(full)
    index = small_side(index)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").select(
        F.md5(F.col("text").cast("binary")).alias("text_key"), words(F.col("text")).alias("tokens")
    )
    sets = texts.select("text_key", shingles(F.col("tokens"), size).alias("set"))
    # Whether a text is long enough is known before anything is joined.
    looked = sets.select("text_key", F.size("set").alias("length"), F.explode("set").alias("shingle"))
    candidates = materialize(
        looked.join(index, "shingle").where(100 * F.col("length") >= percent * F.col("n"))
        .select("text_key", "item_id").distinct()
    )
    chosen = small_side(candidates.select("text_key").distinct())
    # Candidate texts only: their shingles that belong to any item, then those of the candidate pair.
    wanted = small_side(full.select("shingle").distinct())
    held = (
        texts.join(chosen, "text_key", "left_semi")
        .select("text_key", F.explode(F.array_distinct(shingles(F.col("tokens"), size))).alias("shingle"))
        .join(wanted, "shingle", "left_semi").distinct()
    )
    pairs = candidates.join(full, "item_id")
    return (
        pairs.join(held, ["text_key", "shingle"])
        .groupBy("text_key", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
        .where(100 * F.col("n_shared") >= percent * F.col("n"))
        .select("text_key", F.col("item_id.id").alias("item_id"), F.col("n").cast("long").alias("n_item"), "n_shared")
    )


def text_key(text: Column) -> Column:
    return F.md5(text.cast("string").cast("binary"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The documents that hold no test item, with all their columns.

    Rows without text stay. Columns may have any name besides doc_id and text.
    """
    found = small_side(find_items(docs, items, size, percent).select("text_key").distinct())
    key = text_key(docs["text"])
    return docs.join(found, key == found["text_key"], "left_anti")


SQL = r"""
WITH dw AS (
  SELECT doc_id, text, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN len(w) || ':' || array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
s AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN len(w) || ':' || array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1)
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared
FROM ds JOIN s USING (g) JOIN n USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 80 * n"""
