"""Theme clustering of claim embeddings: k-means, density, agglomerative; quality and labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import claim_sentence
from colloquy.functions.vectors import dot, normalize
from colloquy.operators.graph import connected_components
from colloquy.operators.ordered import first_rows
from colloquy.operators.similarity import (
    DEFAULT_PLAN, BlockPlan, block_join, cell_index, fold_copies, join_chunks, neighbour_counts,
    spanning_edges, stack, top_matches, unit_vectors,
)
from colloquy.session import discard, materialize

#: Name, description and keywords of a cluster from sentences of its claims; None or an exception if it cannot tell.
Labeler = Callable[[list[str]], tuple[str, str, list[str]] | None]

#: Similarities of the rows that a merge leaves, from (similarities so far, rows that stay, rows that join them).
Merge = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Names, similarities and merge of clusters from their rows in the order of names.
Similarities = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, Merge]]

# Every clustering returns (id, cluster); cluster is null for noise. Iterations end when a round
# changes nothing.


def _ready(claims: DataFrame) -> DataFrame:
    return unit_vectors(claims.withColumn("id", F.col("claim_id"))).select("id", "vec")


def automatic_k(n: int) -> int:
    return max(1, math.ceil(math.sqrt(n / 2)))


# -- k-means ----------------------------------------------------------------------------------------------


def kmeans_clusters(claims: DataFrame, k: int | None = None, max_iterations: int = 100, seed: int = 42) -> DataFrame:
    """Cosine k-means. With fewer points than clusters every point is its own cluster.

    MLlib draws the first centers (k-means||). Its steps would send the distances of all pairs of centers to the
    driver, as many as there are points; here a step sends the moved centers only. A step ends the search when
    no center moves by more than MLlib's tolerance. Zero vectors have no direction; they are left as noise.
    """
    rows = materialize(_ready(claims))
    n = rows.count()
    k = k or automatic_k(n)
    if n < k:
        return rows.select("id", F.col("id").cast("string").alias("cluster"))
    usable = rows.where(dot(F.col("vec"), F.col("vec")) > 0).withColumn("features", array_to_vector("vec"))
    drawn = KMeans(k=k, maxIter=0, seed=seed, distanceMeasure="cosine").fit(usable)
    centers = _scaled(np.array(drawn.clusterCenters()))
    # Written without the zero vectors, which every step would look for again.
    points = materialize(usable.select("id", "vec"))
    for _ in range(max_iterations):
        moved = _moved_centers(points, centers)
        settled = (1 - (moved * centers).sum(axis=1) <= CENTER_TOLERANCE).all()
        centers = moved
        if settled:
            break
    return rows.select("id").join(_nearest_center(points, centers), "id", "left")


#: Cosine distance that a center may still move in the last step; MLlib's default.
CENTER_TOLERANCE = 1e-4
#: Similarities of points and centers that a task holds at a time.
_SIMILARITIES = 1 << 21


def _scaled(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(batch: pa.RecordBatch, centers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Unit vectors of a batch with the number of the most similar center, the first of equals; by stretches of rows."""
    column = batch.column(batch.schema.get_field_index("vec"))
    vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    step = max(1, _SIMILARITIES // len(centers))
    for start in range(0, batch.num_rows, step):
        unit = _scaled(vectors[start:start + step])
        yield start, unit, (unit @ centers.T).argmax(axis=1)


def _moved_centers(points: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Unit-length mean of the points of each center. One without points, or whose points cancel out, stays."""
    shared = points.sparkSession.sparkContext.broadcast(centers)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(shared.value.shape), np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for _, unit, nearest in _nearest(batch, shared.value):
                order = np.argsort(nearest, kind="stable")
                used, first = np.unique(nearest[order], return_index=True)
                totals[used] += np.add.reduceat(unit[order], first)
                counts[used] += np.diff(np.append(first, len(order)))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"center": pa.array(used, pa.int32()), "total": pa.array(
            list(totals[used]), pa.list_(pa.float64()))})

    parts = points.mapInArrow(sums, "center int, total array<double>")
    united = parts.groupBy("center").agg(Summarizer.sum(array_to_vector("total")).alias("total"))
    found = united.select("center", vector_to_array("total").alias("total")).collect()
    shared.unpersist()
    moved = centers.copy()
    for row in found:
        total = np.array(row["total"])
        if total.any():
            moved[row["center"]] = total / np.linalg.norm(total)
    return moved


def _nearest_center(points: DataFrame, centers: np.ndarray) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [str(c) for _, _, nearest in _nearest(batch, shared.value) for c in nearest.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.string())], names=["id", "cluster"])

    return points.mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, cluster string")


# -- density ------------------------------------------------------------------------------------------------


def dbscan_clusters(
    claims: DataFrame, epsilon: float = 0.3, min_points: int = 3, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """Density clusters: (id, cluster, is_core); the cluster is named by its smallest core id.

    Neighbours are counted, not listed. Core points are connected through spanning edges, and a
    border point, which has fewer than `min_points` neighbours by definition, keeps those few core
    neighbours and joins the cluster with the smallest name. Copies of a vector are folded into one
    weighted point first.
    """
    similarity = 1 - epsilon
    reps, copies = fold_copies(materialize(_ready(claims)))
    points = materialize(reps.withColumn("weight", F.col("copies")).drop("copies"))
    counts = neighbour_counts(points, similarity, plan)
    # Copies are neighbours of each other as well.
    degrees = points.join(counts, "id", "left").select(
        "id", "vec", (F.coalesce("neighbours", F.lit(0)) + F.col("weight") - 1).alias("degree")
    )
    degrees = materialize(degrees)
    core = degrees.where(F.col("degree") >= min_points).select("id", "vec")
    border = degrees.where((F.col("degree") < min_points) & (F.col("degree") > 0)).select("id", "vec")
    labels = connected_components(core, spanning_edges(core, similarity, plan))
    labels = materialize(labels.select("id", F.col("component").alias("cluster")))
    kind = degrees.schema["id"].dataType.simpleString()

    def touching(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(dots >= similarity)
        return pd.DataFrame({"id": lpdf["id"].to_numpy()[i], "core_id": rpdf["id"].to_numpy()[j]})

    # A border point touches fewer than `min_points` core points.
    near = block_join(border, core, similarity, touching, f"id {kind}, core_id {kind}", plan, lambda found: found)
    joined = near.join(labels.select(F.col("id").alias("core_id"), "cluster"), "core_id")
    edge_labels = joined.groupBy("id").agg(F.min("cluster").alias("cluster"))
    every = labels.withColumn("is_core", F.lit(True)).unionByName(edge_labels.withColumn("is_core", F.lit(False)))
    found = copies.join(every.withColumnRenamed("id", "rep_id"), "rep_id", "left")
    return found.select("id", "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))


# -- agglomerative -----------------------------------------------------------------------------------------


def single_linkage(claims: DataFrame, min_similarity: float = 0.5, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Merging while any two members are similar enough is the components of the threshold graph."""
    reps, copies = fold_copies(materialize(_ready(claims)))
    reps = materialize(reps.select("id", "vec"))
    labels = connected_components(reps, spanning_edges(reps, min_similarity, plan))
    return copies.join(labels.withColumnRenamed("id", "rep_id"), "rep_id").select("id", F.col("component").alias("cluster"))


def _mutual(best: DataFrame) -> DataFrame:
    """Reciprocal best partners as (gone, into): the smaller name stays."""
    other = best.select(F.col("id").alias("partner"), F.col("partner").alias("back"))
    return best.join(other, "partner").where((F.col("back") == F.col("id")) & (F.col("id") > F.col("partner"))).select(
        F.col("id").alias("gone"), F.col("partner").alias("into")
    )


#: Rows of clusters that still have a partner, up to which one task makes all their merges.
SETTLED_ROWS = 4096


def _settled(state: DataFrame, best: DataFrame, similarities: Similarities, min_similarity: float) -> DataFrame | None:
    """All merges that are left as (gone, into), or None if too many rows have a partner.

    Only clusters with a partner can merge, and their partners are among them.
    """
    name = "cluster" if "cluster" in state.columns else "id"
    # A claim that comes twice is one cluster; claims of one id with different vectors are left to the rounds.
    rows = materialize(state.join(best.select(F.col("id").alias(name)), name, "left_semi").dropDuplicates())
    if rows.count() > SETTLED_ROWS or (name == "id" and rows.select("id").distinct().count() < rows.count()):
        discard(rows)
        return None
    kind = state.schema[name].dataType.simpleString()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        names, sims, merge = similarities(pdf.sort_values(name, kind="stable").reset_index(drop=True))
        into, every = np.arange(len(names)), np.arange(len(names))
        np.fill_diagonal(sims, -np.inf)
        while True:
            # Names are in order, so the first of equals has the smallest.
            partner = sims.argmax(axis=1)
            stay = np.flatnonzero((sims[every, partner] >= min_similarity) & (partner[partner] == every) & (every < partner))
            if not len(stay):
                return pd.DataFrame({"gone": names[into != every], "into": names[into[into != every]]})
            gone = partner[stay]
            home = every.copy()
            home[gone] = stay
            into = home[into]
            sims[stay] = merge(sims, stay, gone)
            # The pairs among merged clusters, told from both sides alike.
            sims[np.ix_(stay, stay)] = np.minimum(sims[np.ix_(stay, stay)], sims[np.ix_(stay, stay)].T)
            sims[:, stay] = sims[stay].T
            sims[stay, stay] = -np.inf
            sims[gone], sims[:, gone] = -np.inf, -np.inf

    return materialize(rows.groupBy().applyInPandas(settle, f"gone {kind}, into {kind}"))


def _mean_similarities(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Merge]:
    vectors, sizes = stack(rows["vec"]), rows["size"].to_numpy(dtype=np.float64)

    def merge(sims: np.ndarray, stay: np.ndarray, gone: np.ndarray) -> np.ndarray:
        a, b = sizes[stay, None], sizes[gone, None]
        vectors[stay] = (vectors[stay] * a + vectors[gone] * b) / (a + b)
        sizes[stay] += sizes[gone]
        made = vectors[stay] @ vectors.T
        made[:, np.isneginf(sims).all(axis=0)] = -np.inf
        made[:, gone] = -np.inf
        return made

    return rows["id"].to_numpy(), vectors @ vectors.T, merge


def _least_similarities(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Merge]:
    vectors, names = stack(rows["vec"]), rows["cluster"].to_numpy()
    starts = np.flatnonzero(~rows["cluster"].duplicated())
    sims = np.minimum.reduceat(np.minimum.reduceat(vectors @ vectors.T, starts, axis=0), starts, axis=1)

    def merge(sims: np.ndarray, stay: np.ndarray, gone: np.ndarray) -> np.ndarray:
        made = np.minimum(sims[stay], sims[gone])
        # A merged cluster is as similar to another merged one as the less similar half of it.
        made[:, stay] = np.minimum(made[:, stay], made[:, gone])
        return made

    return names[starts], sims, merge


def _agglomerate(
    member_of: DataFrame, state: DataFrame, best_of: Callable[[DataFrame, DataFrame | None], DataFrame],
    merged: Callable[[DataFrame, DataFrame], DataFrame], similarities: Similarities, min_similarity: float,
) -> DataFrame:
    """Merges all reciprocal best partners per round: (id, cluster), clusters named by their smallest id.

    `best_of(state, asked)` gives the best partner (id, partner) of the asked clusters, of all if None. No
    cluster that comes from a merge is more similar to a third one than the better of its halves was, so
    merging reciprocal pairs at once equals merging the best pair one at a time, a cluster keeps its
    partner until that partner merges, and one without a partner never gets any. When few clusters have one,
    one task makes the merges that are left, so that their rounds, of which many make a merge or two, cost no jobs.
    """
    best, is_whole = materialize(best_of(state, None)), True
    while True:
        last = None if best.isEmpty() else _settled(state, best, similarities, min_similarity)
        if last is not None:
            return materialize(_renamed(member_of, last))
        merges = materialize(_mutual(best))
        if merges.isEmpty():
            # Only equal similarities, asked for at different times, can leave partners in a circle.
            if is_whole or best.isEmpty():
                return member_of
            best, is_whole = materialize(best_of(state, None)), True
            continue
        halves = materialize(merges.select(F.explode(F.array("gone", "into")).alias("id")))
        past = best, state, member_of, halves, merges
        state, member_of = materialize(merged(state, merges)), materialize(_renamed(member_of, merges))
        left = best.join(halves, "id", "left_anti")
        met = halves.withColumnRenamed("id", "partner")
        asked = merges.select(F.col("into").alias("id")).unionByName(left.join(met, "partner", "left_semi").select("id"))
        kept = left.join(met, "partner", "left_anti").select("id", "partner")
        best, is_whole = materialize(kept.unionByName(best_of(state, materialize(asked)))), False
        discard(*past)


def average_linkage(claims: DataFrame, min_similarity: float = 0.5, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Average linkage on cluster means: the mean pairwise cosine of two clusters is the dot
    product of their mean unit vectors, so the state is one vector per cluster, never a pair table.
    """
    reps, copies = fold_copies(materialize(_ready(claims)))
    clusters = materialize(reps.select("id", "vec", F.col("copies").alias("size")))

    def best_of(state: DataFrame, asked: DataFrame | None) -> DataFrame:
        seekers = state if asked is None else state.join(asked, "id", "left_semi")
        found = top_matches(
            seekers.select("id", "vec", F.array("id").alias("exclude")), state.select("id", "vec", F.array("id").alias("tags")),
            1, min_similarity, plan,
        )
        return found.select(F.col("query_id").alias("id"), F.col("match_id").alias("partner"))

    return _agglomerate(copies.select("id", F.col("rep_id").alias("cluster")), clusters, best_of, _merge_means, _mean_similarities, min_similarity)


def _renamed(member_of: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows (.., cluster) under the names after the merges."""
    others = [c for c in member_of.columns if c != "cluster"]
    return member_of.join(merges, F.col("cluster") == F.col("gone"), "left").select(
        *others, F.coalesce("into", "cluster").alias("cluster")
    )


def _merge_means(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """Two-way merges: the vanishing side is joined to the staying side once, no grouping."""
    guests = clusters.join(merges, F.col("id") == F.col("gone")).select(
        F.col("into").alias("id"), F.col("vec").alias("_vec"), F.col("size").alias("_size")
    )
    stay = clusters.join(merges.select(F.col("gone").alias("id")), "id", "left_anti").join(guests, "id", "left")
    total = F.col("size") + F.col("_size")
    mixed = F.zip_with("vec", "_vec", lambda x, y: (x * F.col("size") + y * F.col("_size")) / total)
    return stay.select(
        "id", F.when(F.col("_size").isNull(), F.col("vec")).otherwise(mixed).alias("vec"),
        F.coalesce(total, F.col("size")).alias("size"),
    )


def complete_linkage(claims: DataFrame, min_similarity: float = 0.5, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Complete linkage: the similarity of two clusters is that of their least similar members.

    The state is the points with the names of their clusters. Which cluster is nearest is computed from the
    points each time it is asked, block by block, so no table of pairs is kept, however dense a group is.
    """
    reps, copies = fold_copies(materialize(_ready(claims)))
    points = materialize(reps.select("id", "vec", F.col("id").alias("cluster")))

    def best_of(state: DataFrame, asked: DataFrame | None) -> DataFrame:
        return _complete_partners(complete_candidates(state, asked, min_similarity, plan))

    return _agglomerate(copies.select("id", F.col("rep_id").alias("cluster")), points, best_of, _renamed, _least_similarities, min_similarity)


def complete_candidates(
    points: DataFrame, asked: DataFrame | None, min_similarity: float, plan: BlockPlan = DEFAULT_PLAN
) -> DataFrame:
    """What blocks say of partners under complete linkage: (id, partner, similarity, needed).

    Clusters meet where the points that name them can be similar enough; all their points come along, a
    cluster whole in one block, or in pieces of half a block. A block names the best whole partner of each
    whole cluster, and for clusters in pieces every pair of pieces that is similar enough throughout:
    `needed` pairs of pieces make a pair of clusters.
    """
    kind = points.schema["id"].dataType.simpleString()
    names = materialize(points.where(F.col("id") == F.col("cluster")).select("id", "vec"))
    half = max(1, plan.block_rows // 2)
    sizes = points.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("wanted"))
    piece = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("wanted")).cast("int")
    cut = materialize(points.join(sizes, "cluster").select("cluster", piece.alias("piece"), "vec"))
    # Hashing may leave a piece empty; only the others can be waited for.
    held = cut.select("cluster", "piece").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("pieces"))
    pieces = materialize(
        cut.join(held, "cluster")
        .withColumn("id", F.concat_ws("/", F.col("cluster").cast("string"), F.col("piece").cast("string")))
    )
    seekers = names if asked is None else names.join(asked, "id", "left_semi")
    index = cell_index(names, plan)
    if index is None:
        lefts, homes = seekers.select("id", F.lit(0).alias("cell")), names.select("id", F.lit(0).alias("cell"))
    else:
        radius = math.sqrt(max(0.0, 2 - 2 * min_similarity))
        lefts = index.visits(seekers.withColumn("radius", F.lit(radius))).select("id", "cell")
        homes = index.rows.select("id", F.col("home").alias("cell"))
    lefts = materialize(lefts.withColumnRenamed("id", "cluster").join(pieces, "cluster"))
    rights = materialize(homes.withColumnRenamed("id", "cluster").join(pieces.select("*"), "cluster"))

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        (lg, lo, ls), (rg, ro, rs) = _grouped(lpdf), _grouped(rpdf)
        least = np.minimum.reduceat(np.minimum.reduceat(dots[lo][:, ro], rs, axis=1), ls, axis=0)
        lc, rc = lg["cluster"].to_numpy(), rg["cluster"].to_numpy()
        need = lg["pieces"].to_numpy()[:, None] * rg["pieces"].to_numpy()[None, :]
        keep = (least >= min_similarity) & (lc[:, None] != rc[None, :])
        # Groups are in the order of their names, so the first of equals has the smallest.
        whole = np.where(keep & (need == 1), least, -np.inf)
        best = whole.argmax(axis=1)
        found = np.flatnonzero(whole[np.arange(len(lc)), best] > -np.inf)
        i, j = np.nonzero(keep & (need > 1))
        i, j = np.concatenate([found, i]), np.concatenate([best[found], j])
        return pd.DataFrame({"id": lc[i], "partner": rc[j], "similarity": least[i, j], "needed": need[i, j]})

    def best(found: pd.DataFrame) -> pd.DataFrame:
        whole = found[found["needed"] == 1].sort_values(["id", "similarity", "partner"], ascending=[True, False, True])
        return pd.concat([whole.drop_duplicates("id"), found[found["needed"] > 1]], ignore_index=True)

    return join_chunks(lefts, rights, block, f"id {kind}, partner {kind}, similarity double, needed long", plan, fold=best)


def _grouped(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Pieces of clusters in the order of their names, the order of rows by piece, and where each piece starts."""
    ordered = rows[["cluster", "piece", "pieces"]].reset_index(drop=True).sort_values(["cluster", "piece"], kind="stable")
    first = ~ordered.duplicated(["cluster", "piece"])
    return ordered[first], ordered.index.to_numpy(), np.flatnonzero(first.to_numpy())


def _complete_partners(found: DataFrame) -> DataFrame:
    whole = found.where("needed = 1").select("id", "partner", "similarity")
    pieced = found.where("needed > 1").groupBy("id", "partner").agg(
        F.min("similarity").alias("similarity"), F.count(F.lit(1)).alias("parts"), F.first("needed").alias("needed")
    ).where("parts = needed").select("id", "partner", "similarity")
    return whole.unionByName(pieced).groupBy("id").agg(
        F.min_by("partner", F.struct(-F.col("similarity"), F.col("partner"))).alias("partner")
    )


# -- centroids, scores, quality --------------------------------------------------------------------------------


def mean_vectors(members: DataFrame) -> DataFrame:
    """Mean vector per cluster of (cluster, vec): (cluster, mean, size).

    The summarizer combines map-side, so a cluster of any size sends one vector per task.
    """
    return members.groupBy("cluster").agg(
        Summarizer.mean(array_to_vector("vec")).alias("_mean"), F.count(F.lit(1)).alias("size")
    ).select("cluster", vector_to_array("_mean").alias("mean"), "size")


def centroids(claims: DataFrame, clusters: DataFrame) -> DataFrame:
    """Unit-length mean of the raw vectors of each cluster; a zero mean stays zero."""
    raw = claims.where("embedding is not null").select(F.col("claim_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    members = raw.join(clusters.where("cluster is not null").select("id", "cluster"), "id")
    return mean_vectors(members).select("cluster", normalize(F.col("mean")).alias("centroid"), F.col("size").alias("claim_count"))


def memberships(claims: DataFrame, clusters: DataFrame, centers: DataFrame) -> DataFrame:
    """Cosine of each clustered claim to its centroid."""
    rows = _ready(claims).join(clusters.where("cluster is not null").select("id", "cluster"), "id")
    return rows.join(centers.select("cluster", "centroid"), "cluster").select(
        F.col("id").alias("claim_id"), "cluster", dot(F.col("vec"), F.col("centroid")).alias("membership_score")
    )


def silhouette(claims: DataFrame, clusters: DataFrame, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Mean silhouette (1 - cosine), noise and lone members skipped: one row (silhouette, points).

    The mean distance of x to a cluster is 1 - x.mean, so the nearest other cluster is one of the
    two most similar cluster means; no pair of points is formed.
    """
    rows = materialize(_ready(claims).join(clusters.where("cluster is not null").select("id", "cluster"), "id"))
    means = materialize(mean_vectors(rows))
    own = rows.join(means.select("cluster", "mean", "size"), "cluster").where("size > 1")
    n = F.col("size")
    # The point itself is taken out of its cluster's mean.
    inside = (dot(F.col("vec"), F.col("mean")) * n - dot(F.col("vec"), F.col("vec"))) / (n - 1)
    own = own.select("id", "cluster", (1 - inside).alias("a"))
    targets = means.select(F.col("cluster").alias("id"), F.col("mean").alias("vec"), F.array("cluster").alias("tags"))
    seekers = rows.select("id", "vec", F.array("cluster").alias("exclude"))
    # Rounding can put opposite vectors below -1, so no threshold applies here.
    other = top_matches(seekers, targets, 1, -2.0, plan).select(F.col("query_id").alias("id"), (1 - F.col("similarity")).alias("b"))
    scored = own.join(other, "id").withColumn("top", F.greatest("a", "b"))
    s = F.when(F.col("top") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("top"))
    return scored.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"), F.count(F.lit(1)).alias("points"))


# -- labels and themes ---------------------------------------------------------------------------------------------


def most_frequent(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """Most frequent value per group; among equals the one seen first by `position`."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(group).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias(value), F.min_by("n", F.struct(-F.col("n"), F.col("first"))).alias("n")
    )


def fallback_labels(claims: DataFrame, clusters: DataFrame, position: Column) -> DataFrame:
    """Name, description and keywords per cluster from its subjects and predicates."""
    rows = clusters.where("cluster is not null").join(claims.withColumn("id", F.col("claim_id")), "id").select(
        "cluster", "subject", "predicate", position.alias("position")
    )
    subjects = most_frequent(rows, "cluster", "subject", "position").select("cluster", "subject")
    predicates = most_frequent(rows, "cluster", "predicate", "position").select("cluster", "predicate")
    distinct = rows.groupBy("cluster", "subject").agg(F.min("position").alias("position"))
    first = first_rows(distinct, ["cluster"], [F.asc("position"), F.asc("subject")], 5)
    keywords = first.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda r: r["subject"]).alias("keywords")
    )
    told = F.concat(F.lit("Claims where various subjects "), F.replace(F.col("predicate"), F.lit("-"), F.lit(" ")), F.lit(" "), F.col("subject"))
    return subjects.join(predicates, "cluster").join(keywords, "cluster").select(
        "cluster", F.concat("subject", F.lit(" Topics")).alias("name"), told.alias("description"), "keywords"
    )


def label_clusters(
    claims: DataFrame, clusters: DataFrame, position: Column, labeler: Labeler, sample: int = 20
) -> DataFrame:
    """Name, description and keywords per cluster by a labeler, and computed ones where it fails.

    The labeler gets the sentences of the first `sample` claims (by position) of one cluster after the other
    and returns a name, a description and keywords. A cluster for which it raises, or returns None, is
    labelled like without it.
    """
    rows = clusters.where("cluster is not null").join(claims.withColumn("id", F.col("claim_id")), "id").select(
        "cluster", claim_sentence("subject", "predicate", "object").alias("sentence"), position.alias("position"), "id"
    )
    first = first_rows(rows, ["cluster"], [F.asc("position"), F.asc("id")], sample)
    told = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("told"))

    @F.pandas_udf("struct<name:string,description:string,keywords:array<string>>")
    def label(samples: pd.Series) -> pd.DataFrame:
        out = []
        for sentences in samples:
            try:
                out.append(labeler(list(sentences)) or (None, None, None))
            except Exception:  # noqa: BLE001 - the computed label takes its place
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["name", "description", "keywords"])

    labelled = told.select("cluster", label(F.transform("told", lambda t: t["sentence"])).alias("given"))
    default = fallback_labels(claims, clusters, position)
    given = F.col("given.name").isNotNull()
    return default.join(labelled, "cluster").select(
        "cluster", *[F.when(given, F.col(f"given.{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "description", "keywords")]
    )


def build_themes(
    claims: DataFrame, clusters: DataFrame, run_id: str, position: Column, min_cluster_size: int = 3,
    labels: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Themes, memberships and unclustered claims from a clustering.

    `labels` (cluster, name, description, keywords) may come from `label_clusters`; the default is
    computed from subjects and predicates. Small clusters dissolve into unclustered claims.
    """
    clusters = materialize(clusters.select("id", "cluster"))
    large = clusters.where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_cluster_size
    )
    kept = materialize(clusters.join(large.select("cluster"), "cluster", "left_semi").select("id", "cluster"))
    centers = materialize(centroids(claims, kept))
    named = labels if labels is not None else fallback_labels(claims, kept, position)
    theme_id = F.concat(F.lit(f"theme:{run_id}_"), F.col("cluster").cast("string"))
    themes = centers.join(named, "cluster").select(
        theme_id.alias("theme_id"), "name", "description", "keywords", "centroid", "claim_count", F.lit(True).alias("is_active")
    )
    members = memberships(claims, kept, centers).select("claim_id", theme_id.alias("theme_id"), "membership_score")
    lone = claims.where("embedding is not null").select("claim_id").join(
        kept.select(F.col("id").alias("claim_id")), "claim_id", "left_anti"
    )
    return themes, members, lone


def theme_list(themes: DataFrame) -> DataFrame:
    return themes.where("is_active").orderBy(F.desc("claim_count"), "theme_id")


def theme_members(members: DataFrame, claims: DataFrame, theme: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a theme's claims, the closest first."""
    page = members.where(F.col("theme_id") == theme).orderBy(F.desc("membership_score"), "claim_id").offset(offset).limit(limit)
    return page.join(claims.select("claim_id", "subject", "predicate", "object"), "claim_id")


def theme_stats(themes: DataFrame) -> DataFrame:
    largest = F.min_by("name", F.struct(-F.col("claim_count"), F.col("theme_id")))
    return themes.where("is_active").agg(
        F.count(F.lit(1)).alias("themes"), F.coalesce(F.sum("claim_count"), F.lit(0)).alias("clustered_claims"),
        F.avg("claim_count").alias("avg_claims"), largest.alias("largest_theme"),
    )


def publish_themes(previous: DataFrame | None, themes: DataFrame) -> DataFrame:
    """New version of the theme table: earlier themes stay, switched off."""
    if previous is None:
        return themes
    return previous.withColumn("is_active", F.lit(False)).unionByName(themes)
