"""Semantic deduplication of claims: incremental, exact, and equal to one-by-one processing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import cosine
from colloquy.operators.graph import connected_components
from colloquy.operators.ordered import first_rows
from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan, block_join, copy_code, spanning_edges, stack, unit_vectors
from colloquy.session import Ledger, discard, materialize

#: Rows of a connected group that one task settles in order; it holds at most that many vectors.
GROUP_ROWS = 8192


def _near(left: DataFrame, right: DataFrame, threshold: float, plan: BlockPlan) -> DataFrame:
    """Ids of left rows with an earlier right row at or above the threshold."""
    kind = left.schema["id"].dataType.simpleString()

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(dots >= threshold)
        earlier = rpdf["ord"].to_numpy()[j] < lpdf["ord"].to_numpy()[i]
        return pd.DataFrame({"id": lpdf["id"].to_numpy()[np.unique(i[earlier])]})

    return block_join(left, right, threshold, block, f"id {kind}", plan, lambda found: found.drop_duplicates()).distinct()


def _settled(groups: DataFrame, threshold: float) -> DataFrame:
    """Outcome (id, is_leader) of groups (component, id, vec, ord) that are whole up to their last row.

    A task reads its groups one after the other, in order, and holds the leaders of one group only.
    """
    kind = groups.schema["id"].dataType.simpleString()

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, leaders, held = None, np.zeros((0, 0)), 0
        for batch in batches:
            if len(batch) == 0:
                continue
            vectors, flags = stack(batch["vec"]), np.zeros(len(batch), dtype=bool)
            for i, component in enumerate(batch["component"]):
                if component != current:
                    current, leaders, held = component, np.zeros((4, vectors.shape[1])), 0
                if held and (leaders[:held] @ vectors[i]).max() >= threshold:
                    continue
                if held == len(leaders):
                    leaders = np.concatenate([leaders, np.zeros_like(leaders)])
                leaders[held] = vectors[i]
                held += 1
                flags[i] = True
            yield pd.DataFrame({"id": batch["id"], "is_leader": flags})

    ordered = groups.repartition("component").sortWithinPartitions("component", "ord")
    return ordered.select("component", "id", "vec").mapInPandas(settle, f"id {kind}, is_leader boolean")


def choose_canonical(
    rows: DataFrame, threshold: float, plan: BlockPlan = DEFAULT_PLAN, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Which rows (id, vec, ord) stay canonical when processed in order: (id, is_leader).

    A row becomes canonical unless an earlier canonical row is at least `threshold` similar. Rows that no
    similarity connects cannot decide about each other, so every connected group is settled by itself, in
    order, by one task, as far as its first `group_rows` rows; chains of any kind end there. Of larger
    groups the canonical rows so found take out their neighbours, rows without an earlier open neighbour
    settle too, and what is left is grouped again. This yields exactly the sequential outcome. Blocks emit
    spanning edges or one flag per row, never the similar pairs, and settled rows are written once.
    """
    open_rows = materialize(rows.select("id", "vec", "ord"))
    settled = Ledger(rows.sparkSession)
    settled.add(open_rows.where("false").select("id", F.lit(True).alias("is_leader")))
    while not open_rows.isEmpty():
        edges = materialize(spanning_edges(open_rows.select("id", "vec"), threshold, plan))
        linked = edges.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
        settled.add(open_rows.join(linked, "id", "left_anti").select("id", F.lit(True).alias("is_leader")))
        grouped = materialize(open_rows.join(connected_components(linked, edges), "id"))
        first = materialize(first_rows(grouped, ["component"], [F.asc("ord")], group_rows, "place").drop("place"))
        roles = settled.add(_settled(first, threshold))
        rest = materialize(grouped.join(first.select("id"), "id", "left_anti").select("id", "vec", "ord"))
        spent = [open_rows, edges, grouped]
        open_rows = rest
        if not rest.isEmpty():
            leaders = first.join(roles.where("is_leader"), "id", "left_semi").select("id", "vec", "ord")
            gone = materialize(_near(rest, leaders, threshold, plan))
            settled.add(gone.select("id", F.lit(False).alias("is_leader")))
            left = materialize(rest.join(gone, "id", "left_anti"))
            blocked = materialize(_near(left, left, threshold, plan))
            fresh = materialize(left.join(blocked, "id", "left_anti"))
            settled.add(fresh.select("id", F.lit(True).alias("is_leader")))
            waiting = left.join(blocked, "id", "left_semi")
            beaten = materialize(_near(waiting, fresh, threshold, plan))
            settled.add(beaten.select("id", F.lit(False).alias("is_leader")))
            open_rows = materialize(waiting.join(beaten, "id", "left_anti"))
            spent += [rest, gone, left, blocked, fresh, beaten]
        discard(*spent, first)
    return settled.rows()


def deduplicate_claims(
    new_claims: DataFrame,
    existing: DataFrame,
    duplicate_threshold: float = 0.92,
    related_threshold: float = 0.75,
    related_limit: int = 10,
    plan: BlockPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Processes new claims in (extracted_at, claim_id) order against the canonical claims.

    Result per new claim: is_canonical, canonical_claim, similarity to it, and `related` (id and
    similarity of up to ten earlier canonical claims below the duplicate threshold). Equal vectors
    are folded first: whatever comes later than the first copy is a duplicate at similarity 1.
    Exact triples must be merged beforehand (`upsert_triples`).
    """
    batch = unit_vectors(new_claims.withColumn("id", F.col("claim_id")))
    order = F.struct("extracted_at", "claim_id")
    position = F.concat_ws(
        "|", F.date_format("extracted_at", "yyyyMMddHHmmssSSSSSS"),
        F.lpad(F.col("claim_id").cast("string"), 40, "0") if dict(new_claims.dtypes)["claim_id"] == "bigint"
        else F.col("claim_id"),
    )
    batch = materialize(batch.select("id", "vec", position.alias("ord"), order.alias("key")))
    stored = unit_vectors(existing.where("is_canonical").withColumn("id", F.col("claim_id"))).select(
        "id", "vec", F.lit("").alias("ord")
    )
    stored = materialize(stored)

    # Copies of one vector: the first in order speaks for the rest.
    hashed = batch.withColumn("code", copy_code(F.col("vec"), F.col("id")))
    first = hashed.groupBy("code").agg(F.min_by("id", "ord").alias("rep_id"))
    copies = hashed.select("id", "code").join(first, "code").select("id", "rep_id")
    speakers = materialize(batch.join(first.select(F.col("rep_id").alias("id")), "id", "left_semi"))

    taken = materialize(_near(speakers, stored, duplicate_threshold, plan))
    free = speakers.join(taken, "id", "left_anti")
    roles = materialize(choose_canonical(free, duplicate_threshold, plan))
    fresh = speakers.join(roles.where("is_leader"), "id", "left_semi").select("id", "vec", "ord")
    canon = materialize(stored.unionByName(fresh))

    # Duplicates are linked after all decisions, to the most similar earlier canonical row.
    dups = speakers.join(fresh.select("id"), "id", "left_anti").select("id", "vec", "ord")
    links = _top_earlier(dups, canon, 1, duplicate_threshold, None, plan).select(
        F.col("query_id").alias("id"), F.col("match_id").alias("canonical_claim"), "similarity"
    )
    related = _top_earlier(fresh, canon, related_limit, related_threshold, duplicate_threshold, plan)
    related = related.groupBy(F.col("query_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("match_id").alias("claim_id"), "similarity"))).alias("related")
    )
    spoken = speakers.select("id").join(links, "id", "left").join(related, "id", "left").withColumn(
        "is_canonical", F.col("canonical_claim").isNull()
    )
    own = spoken.select(
        F.col("id").alias("rep_id"), F.col("is_canonical").alias("rep_canonical"), "canonical_claim",
        "similarity", "related",
    )
    is_rep = F.col("id") == F.col("rep_id")
    return copies.join(own, "rep_id").select(
        F.col("id").alias("claim_id"),
        (is_rep & F.col("rep_canonical")).alias("is_canonical"),
        F.when(~is_rep & F.col("rep_canonical"), F.col("rep_id")).otherwise(F.col("canonical_claim")).alias("canonical_claim"),
        F.when(~is_rep & F.col("rep_canonical"), F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
        F.when(is_rep, F.col("related")).alias("related"),
    )


def _top_earlier(
    left: DataFrame, right: DataFrame, k: int, low: float, below: float | None, plan: BlockPlan
) -> DataFrame:
    """Best k earlier right rows per left row with similarity in [low, below)."""
    kind = left.schema["id"].dataType.simpleString()

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        keep = dots >= low
        if below is not None:
            keep &= dots < below
        i, j = np.nonzero(keep)
        earlier = rpdf["ord"].to_numpy()[j] < lpdf["ord"].to_numpy()[i]
        i, j = i[earlier], j[earlier]
        found = pd.DataFrame({
            "query_id": lpdf["id"].to_numpy()[i], "match_id": rpdf["id"].to_numpy()[j],
            "similarity": dots[i, j], "match_ord": rpdf["ord"].to_numpy()[j],
        })
        return best(found)

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["query_id", "similarity", "match_ord", "match_id"], ascending=[True, False, True, True])
        return found.groupby("query_id", sort=False).head(k)

    schema = f"query_id {kind}, match_id {kind}, similarity double, match_ord string"
    found = block_join(left, right, low, block, schema, plan, best)
    return first_rows(found, ["query_id"], [F.desc("similarity"), F.asc("match_ord"), F.asc("match_id")], k, "rank")


def canonical_confidence(existing: DataFrame, new_claims: DataFrame, outcome: DataFrame) -> DataFrame:
    """Confidence of each canonical claim raised to the best of its duplicates."""
    all_claims = existing.select("claim_id", "confidence").unionByName(new_claims.select("claim_id", "confidence"))
    raised = outcome.where("canonical_claim is not null").join(new_claims.select("claim_id", "confidence"), "claim_id").groupBy(
        F.col("canonical_claim").alias("claim_id")
    ).agg(F.max("confidence").alias("_best"))
    return all_claims.join(raised, "claim_id", "left").select(
        "claim_id", F.greatest("confidence", F.coalesce("_best", "confidence")).alias("confidence")
    )


def merge_duplicates(
    merges: DataFrame, claims: DataFrame, stances: DataFrame, merge_stances: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges `(dup_id, canon_id)` rows: (edges, new stance table, report per merge).

    Stance rows of a duplicate move to its canonical claim: all of them when that claim holds no
    user stance, else only those without one. Rows that meet on one claim are folded into one,
    keeping the canonical's own values first.
    """
    v = claims.select("claim_id", "embedding")
    a = v.select(F.col("claim_id").alias("dup_id"), F.col("embedding").alias("_a"))
    b = v.select(F.col("claim_id").alias("canon_id"), F.col("embedding").alias("_b"))
    known = merges.join(a, "dup_id").join(b, "canon_id")
    edges = known.select(
        F.col("dup_id").alias("src_id"), F.col("canon_id").alias("dst_id"),
        F.coalesce(cosine(F.col("_a"), F.col("_b")), F.lit(0.0)).alias("similarity"),
        F.lit("duplicate").alias("relationship"),
    )
    pairs = known.select("dup_id", "canon_id")
    rated = stances.groupBy(F.col("claim_id").alias("canon_id")).agg(
        F.bool_or(F.col("user_stance").isNotNull()).alias("canon_rated")
    )
    moving = (
        stances.join(pairs, F.col("claim_id") == F.col("dup_id"))
        .join(rated, "canon_id", "left")
        .withColumn("canon_rated", F.coalesce("canon_rated", F.lit(False)))
    )
    has_own = F.col("user_stance").isNotNull()
    moving = moving.withColumn("_moves", (~F.col("canon_rated") | ~has_own) & F.lit(merge_stances))
    report = pairs.join(
        moving.groupBy("dup_id", "canon_id").agg(
            F.count_if("_moves").alias("stances_moved"),
            F.count_if(F.col("canon_rated") & has_own & F.lit(merge_stances)).alias("stance_conflicts"),
        ),
        ["dup_id", "canon_id"], "left",
    ).na.fill(0, ["stances_moved", "stance_conflicts"])
    fields = [c for c in stances.columns if c != "claim_id"]
    moved = moving.where("_moves").select(F.col("canon_id").alias("claim_id"), *fields, F.lit(1).alias("_guest"), "dup_id")
    stays = stances.join(moving.where("_moves").select(F.col("dup_id").alias("claim_id")), "claim_id", "left_anti")
    stays = stays.withColumn("_guest", F.lit(0)).withColumn("dup_id", F.lit(None).cast(stances.schema["claim_id"].dataType))
    # The first non-null value wins: own rows before guests, guests in id order.
    folded = moved.unionByName(stays).groupBy("claim_id").agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("_guest", "dup_id"))).alias(c) for c in fields
    ])
    return edges, folded, report
