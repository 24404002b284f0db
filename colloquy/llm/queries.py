"""Registered queries of the operators of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    alignment, chat_repair, decontaminate, fingerprints, html_extract, language_id, license_scan, mixing, mixing_sql, near_dedup, pii,
    quality, resampling, token_counts,
)
from colloquy.llm.common import small_side
from colloquy.session import materialize, read_table

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    found = fingerprints.edit_fingerprints(read_table(spark, base, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


_OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i+2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
r AS (
  SELECT doc_id, doc_id AS m FROM d
  UNION
  SELECT CASE WHEN r.doc_id = e.a THEN e.b ELSE e.a END, r.m FROM r JOIN e ON r.doc_id = e.a OR r.doc_id = e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) c USING (doc_id)"""


@query("op4_near_duplicates", _OP4_SQL)
def op4_near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, base, "documents"), words=3, percent=85, bands=36, rows=7)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, base, "documents", spread=True).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.token_counts(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", spread=True)
    model = quality.train(docs, read_table(spark, base, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", spread=True).select("doc_id", "text")
    found = license_scan.license_scan(docs)
    starts = F.col("places.start")
    base_labels = F.array_sort(F.array_distinct("places.label"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("places.label", "notices.label")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.containment"), F.lit(0.0))).alias("score"),
    )


@query("op6_mix_sources", mixing_sql.MIX)
def op6_mix_sources(spark: SparkSession, base: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, base, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_decontaminate", decontaminate.SQL)
def op7_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", spread=True)
    found = materialize(decontaminate.find_items(docs, read_table(spark, base, "benchmark")))
    keys = small_side(found.select("text_key").distinct())
    named = docs.select("doc_id", decontaminate.text_key(F.col("text")).alias("text_key")).join(keys, "text_key", "left_semi")
    return named.join(found, "text_key").select("doc_id", "item_id", "n_item", "n_shared")


@query("op8_private_data")
def op8_private_data(spark: SparkSession, base: str) -> DataFrame:
    return pii.replace_entities(read_table(spark, base, "documents", spread=True).select("doc_id", "text"))


@query("op1_main_text")
def op1_main_text(spark: SparkSession, base: str) -> DataFrame:
    pages = read_table(spark, base, "pages", spread=True).select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_chat_format")
def op9_chat_format(spark: SparkSession, base: str) -> DataFrame:
    turns = chat_repair.repair(read_table(spark, base, "conversations"))
    return turns.select("conv_id", "turn", "role", "pos", "new_role", "action", "inserted", "conversation_cost", "fragment")


@query("op11_align_tokens")
def op11_align_tokens(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, base, "documents", spread=True)
    paths = [str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(docs, *paths)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", spread=True)
    held_out = language_id.held_out()
    model = language_id.train(docs, keep=F.col("doc_id").isNotNull() & ~held_out)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op13_resample", resampling.SQL)
def op13_resample(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", spread=True)
    return resampling.rank_documents(docs, read_table(spark, base, "benchmark"))
