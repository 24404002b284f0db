"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The mix is a row of equal-token slots. Slot i stands at the point frac(i * golden ratio), which a table
of cumulative target weights maps to a source; any stretch of slots holds each source in proportion.
Slots are ranked per source, the documents of a source are laid end to end in keyed random order, pass
after pass, and cut into blocks of one slot's tokens: the k-th slot of a source takes its k-th block. Where
slots hold several tokens, a source whose target is below FINE of them has FINE smaller slots of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import running_total, small_side
from colloquy.session import materialize

#: Number of slots of a schedule; a slot has as many tokens as the mix then needs.
SLOTS = 200_000
#: A source with fewer slots than this would miss its target by a share that counts.
FINE = 256
#: 2^32 divided by the golden ratio: slot i stands at i * GOLDEN mod 2^32.
GOLDEN, CIRCLE = 2654435769, 1 << 32


def words_in(text: Column) -> Column:
    r"""Number of words `[^\x20\x09-\x0D]+`; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sources: DataFrame, weights: list[int], share_percent: int, most: int) -> DataFrame:
    """Targets of sources (source, source_size): weights in turn by code point, null last.

    The targets share `share_percent` of all sizes by weight; no target exceeds `most` times its
    source's size, and what is cut off is shared again by weight among the others until none exceeds.
    That ends where target = min(limit, weight * level) for one level, which is found by ordering the
    sources by limit / weight: those below the level stand at their limit. One row per source.
    """
    by_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    through = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = F.array(*[F.lit(w) for w in weights])
    placed = sources.withColumn("place", F.row_number().over(by_point) - 1)
    weighed = placed.withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int"))).withColumn(
        "cap", F.col("source_size") * most
    )
    sums = (
        weighed.withColumn("cap_through", F.sum("cap").over(through))
        .withColumn("weight_through", F.sum("weight").over(through))
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
    )
    # The level if this source and all before it in the order are shared by weight, those before cut.
    level = (
        F.col("all_size") * share_percent / 100 - (F.col("cap_through") - F.col("cap"))
    ) / (F.col("all_weight") - (F.col("weight_through") - F.col("weight")))
    levels = sums.withColumn("level", level)
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("weight_through").alias("w"), "level"))).over(every)
    return (
        levels.withColumn("final", reached["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "place", "source_size", "target")
    )


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The slots of the mix: (slot, place, rank, tokens), rank counted from 0 per source.

    Each source owns an arc of the circle of points, as wide as its target. Arcs and slots meet in
    equal cells of the circle, so the lookup is a join on the cell and not on ranges. Sources below FINE
    slots of several tokens own no arc: they have about FINE slots of fewer tokens, spread evenly, each
    beside the slot whose number it has.
    """
    spark = targets.sparkSession
    cells = 4096
    width = CIRCLE // cells
    order = Window.orderBy("place")
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = materialize(
        targets.withColumn("all", F.sum("target").over(every))
        .where("all > 0")
        .withColumn("tokens", F.greatest(F.ceil(F.col("all") / slots).cast("long"), F.lit(1).cast("long")))
        .withColumn("fine", (F.col("tokens") > 1) & (F.col("target") < F.col("tokens") * FINE))
        .withColumn("upto", F.sum(F.when(F.col("fine"), 0.0).otherwise(F.col("target"))).over(through))
        .withColumn("total", F.max("upto").over(every))
        .withColumn("slots", F.ceil(F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("all")) / F.col("tokens")).cast("long"))
    )
    arcs = (
        sized.where("total > 0")
        .withColumn("high", F.floor(F.col("upto") / F.col("total") * F.lit(CIRCLE)).cast("long"))
        .withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0).cast("long")))
        .where("high > low")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
        .select("place", "low", "high", "tokens", "slots", "cell")
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.expr(f"pmod(id * {GOLDEN}L, {CIRCLE}L)").alias("point")
    ).withColumn("cell", F.floor(F.col("point") / width))
    taken = (
        points.join(small_side(arcs), "cell")
        .where("point >= low and point < high and slot < slots")
        .select("slot", "place", "tokens", F.floor(F.col("slot") / math.isqrt(slots)).alias("bucket"), F.lit(1).cast("long").alias("one"))
    )
    ranked = running_total(taken, ["place"], "bucket", [F.col("slot")], "one", "rank")
    fine = (
        sized.where("fine and target > 0").withColumn("tokens", F.ceil(F.col("target") / FINE).cast("long"))
        .withColumn("n", F.round(F.col("target") / F.col("tokens")).cast("long")).where("n > 0")
        .withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("part", (F.col("rank") + F.expr(f"pmod(place * {GOLDEN}L, {CIRCLE}L)") / CIRCLE) / F.col("n"))
        .select(F.floor(F.col("part") * F.col("slots")).alias("slot"), "place", "rank", "tokens")
    )
    return materialize(ranked.select("slot", "place", "rank", "tokens").unionByName(fine))


def shuffle_place(doc_id: Column, text: Column, key: str) -> Column:
    """Where a document stands in the keyed random order of its source: 60 bits of a digest."""
    named = F.concat(F.lit(f"{key}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame, weights: list[int] | None = None, share_percent: int = 150, most: int = 2,
    slots: int = SLOTS, key: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shuffle_place.

    size counts words of the whole text (null: 0), target is the source's, taken the words that the mix
    takes from the document, repeats counted. A source's taken words differ from its target by a few
    of its slots at most, and no document exceeds `most` times its size. The null source is one of its own,
    placed last; sources without words have target 0. Reruns agree: the order is a digest of key, doc_id
    and text; repeated rows stand side by side. An empty table gives no rows. Only doc_id, text and
    source are read, so other columns may have any name.
    """
    weights = [3, 1, 2] if weights is None else weights
    sized = materialize(
        docs.select(
            F.col("doc_id"), F.col("source").cast("string").alias("source"),
            words_in(F.col("text").cast("string")).alias("size"),
            shuffle_place(F.col("doc_id"), F.col("text").cast("string"), key).alias("shuffle_place"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    counted = materialize(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    )
    targets = small_side(target_sizes(counted.select("source", "source_size"), weights, share_percent, most))
    rows = counted.agg(F.sum("n").alias("n")).head()["n"] or 0
    # As many buckets as a bucket may have rows: both steps of the running total stay small.
    bucket = F.floor(F.col("shuffle_place") / -(-(1 << 60) // (math.isqrt(rows) + 1)))
    known = (
        sized.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
        .withColumn("bucket", bucket)
    )
    order = [F.col("shuffle_place"), F.col("doc_id"), F.col("size")]
    laid = materialize(running_total(known, ["place"], "bucket", order, "size", "start"))
    taken = pieces(laid, schedule(targets, slots), most).groupBy("row").agg(F.sum("words").alias("taken"))
    return laid.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "shuffle_place",
    )


def pieces(laid: DataFrame, slots: DataFrame, most: int) -> DataFrame:
    """What each slot holds: (slot, row, words), the parts of documents in the block it takes.

    `laid` has row, place, start, size, source_size. There are at most `most` pieces per document and
    one more per block edge. Blocks past `most` passes of a source are cut off.
    """
    tokens = F.col("tokens")
    blocks = small_side(slots.select("place", "tokens").distinct())
    passes = laid.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    spans = passes.select(
        "row", "place", (F.col("start") + F.col("source_size") * F.col("pass")).alias("begin"), "size"
    ).withColumn("end", F.col("begin") + F.col("size"))
    cut = spans.join(blocks, "place").withColumn(
        "rank", F.explode(F.sequence(F.floor(F.col("begin") / tokens), F.floor((F.col("end") - 1) / tokens)))
    )
    return cut.join(small_side(slots.select("slot", "place", "rank")), ["place", "rank"]).select(
        "slot", "row",
        (F.least(F.col("end"), (F.col("rank") + 1) * tokens) - F.greatest(F.col("begin"), F.col("rank") * tokens)).alias("words"),
    )
