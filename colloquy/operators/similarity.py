"""Exact threshold and top-k similarity over vectors, as bounded block joins.

Vectors have length at most 1, so `dot >= t` implies a Euclidean distance of at most
`sqrt(2 - 2t)`. A few reference vectors (pivots) split the space into cells; where they would get too
many, the rows of each cell are split again by pivots of their own. The right side lives in the cell
of its nearest pivot; the left side visits only the cells the triangle inequality cannot rule out: for
a threshold all rows with one radius, for the k best each row with its own, which its home cell tells.
Cells that hold many rows are cut into blocks on both sides, and blocks into chunks of a bounded size: a
task gets two chunks whatever the skew, multiplies their blocks of `block_rows` vectors one pair after the
other with NumPy and emits only what the caller's block function keeps. There are as many chunks as keep
the cores busy, not more, so that a row is sent to few tasks however many rows there are. Nothing is
approximated and no pair is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import normalize
from colloquy.operators.ordered import first_rows
from colloquy.session import materialize

# A block function receives (left rows, right rows, dot products) and returns a frame.
BlockFunction = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame]
# Folds the results of one left block with many right ones to about as many rows as the blocks have.
Fold = Callable[[pd.DataFrame], pd.DataFrame]

BLOCK_ROWS = 2048
#: Rows, and bytes of vectors, that a task holds of each side.
CHUNK_ROWS = 65_536
CHUNK_BYTES = 64 * 1024 * 1024
#: Pairs of chunks for each core, where there are blocks enough.
PAIRS_PER_CORE = 8
#: Result rows after which a task leaves its other pairs of blocks to tasks of their own.
RESULT_ROWS = 4_000_000
CELL_ROWS = 65_536
MAX_PIVOTS = 4096
PIVOT_BYTES = 32 * 1024 * 1024
_SLACK = 1e-6


@dataclass(frozen=True)
class BlockPlan:
    """Sizes of the block join; the defaults suit executors with a few GB per core."""

    block_rows: int = BLOCK_ROWS
    cell_rows: int = CELL_ROWS
    #: Pivots of the first level, and of the second level within one cell of the first.
    pivots: int = MAX_PIVOTS
    chunk_rows: int = CHUNK_ROWS
    result_rows: int = RESULT_ROWS


DEFAULT_PLAN = BlockPlan()


def unit_vectors(df: DataFrame, vector: str = "embedding", into: str = "vec") -> DataFrame:
    return df.where(F.col(vector).isNotNull()).withColumn(into, normalize(F.col(vector)))


def stack(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def spread_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of a sample that lie apart: each is drawn by its squared distance from those drawn before."""
    sample = np.unique(sample, axis=0)
    random = np.random.default_rng(len(sample))
    chosen = [0]
    apart = _distances(sample, sample[:1])[:, 0] ** 2
    while len(chosen) < min(wanted, len(sample)) and apart.max() > 0:
        chosen.append(int(random.choice(len(sample), p=apart / apart.sum())))
        apart = np.minimum(apart, _distances(sample, sample[chosen[-1]:chosen[-1] + 1])[:, 0] ** 2)
        apart[chosen] = 0.0
    return sample[chosen]


def pivots_of(corpus: DataFrame, rows: int, plan: BlockPlan) -> np.ndarray | None:
    """Pivot matrix of a checked size, or None when one cell is enough."""
    wanted = min(plan.pivots, rows // plan.cell_rows)
    if wanted < 2:
        return None
    dimension = corpus.select(F.size("vec").alias("n")).head()["n"]
    wanted = min(wanted, max(1, PIVOT_BYTES // (8 * max(dimension, 1))))
    sample = corpus.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(4 * wanted)
    points = spread_pivots(stack(sample.toPandas()["vec"]), wanted)
    return points if len(points) > 1 else None


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (
        (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    )
    return np.sqrt(np.maximum(squared, 0.0))


def _parts(rows: int, size: int = 1024) -> Iterator[slice]:
    for start in range(0, rows, size):
        yield slice(start, start + size)


def _nearest(vectors: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest point of each vector, and the distance to it."""
    place, reach = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    for part in _parts(len(vectors)):
        distance = _distances(vectors[part], points)
        place[part] = distance.argmin(axis=1)
        reach[part] = distance.min(axis=1)
    return place, reach


def _possible(
    vectors: np.ndarray, radius: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray
) -> list[np.ndarray]:
    """Per vector the numbers of all points whose cell can hold a row within the vector's radius.

    `low` and `high` bound the distance of a cell's rows from its point.
    """
    found: list[np.ndarray] = []
    for part in _parts(len(vectors)):
        distance, r = _distances(vectors[part], points), radius[part, None] + _SLACK
        # A partner y of x in cell j is nearer to point j than to any other point, hence
        # d(x, j) <= d(x, any) + 2r; and d(y, j) differs from d(x, j) by at most r.
        keep = distance <= distance.min(axis=1, keepdims=True) + 2 * r
        keep &= (distance <= high[None, :] + r) & (distance >= low[None, :] - r)
        found.extend(np.flatnonzero(row) for row in keep)
    return found


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@dataclass(frozen=True)
class CellIndex:
    """A corpus in cells: `rows` with the number of their cell (`home`), and what tells cells apart.

    The pivots of the first level and the least and greatest distance of their rows are of a checked
    size and travel with the tasks. Those of the second level, (top, n, vec, low, high), stay a table
    that meets the rows of its first-level cell in slices.
    """

    plan: BlockPlan
    top: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inner: DataFrame | None
    rows: DataFrame

    def place(self, df: DataFrame, keep_reach: bool = False) -> DataFrame:
        """Adds `home`, the cell nearest to each row, and on demand `reach`, the distance to its pivot."""
        placed = _top_placed(df, self.top)
        if self.inner is None:
            placed = placed.withColumn("home", F.col("top")).drop("top")
        else:
            placed = _inner_placed(placed, self.inner, self.plan)
        return placed if keep_reach else placed.drop("reach")

    def visits(self, df: DataFrame) -> DataFrame:
        """One row for each cell that can hold a row within `radius` of a row: adds `cell`.

        What is written down is one row with its list of cells.
        """
        shared = df.sparkSession.sparkContext.broadcast((self.top, self.low, self.high))

        def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    found = _possible(stack(batch["vec"]), batch["radius"].to_numpy(), *shared.value)
                    batch["tops"] = [row.tolist() for row in found]
                    yield batch

        seen = df.mapInPandas(tops, schema=f"{_fields(df)}, tops array<long>")
        if self.inner is None:
            return materialize(seen).withColumn("cell", F.explode("tops")).drop("tops")
        seen = seen.withColumn("top", F.explode("tops")).drop("tops")

        columns = [*df.columns, "cells"]

        def cells(batch: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            if len(batch) == 0 or len(points) == 0:
                return pd.DataFrame(columns=columns)
            found = _possible(
                stack(batch["vec"]), batch["radius"].to_numpy(), stack(points["vec"]),
                points["low"].to_numpy(), points["high"].to_numpy(),
            )
            numbers = points["home"].to_numpy()
            batch["cells"] = [numbers[row].tolist() for row in found]
            return batch[columns]

        met = _beside_inner(seen, self.inner, self.plan, cells, f"{_fields(df)}, cells array<long>")
        return materialize(met).withColumn("cell", F.explode("cells")).drop("cells")


def _top_placed(df: DataFrame, top: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(top)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["top"], batch["reach"] = _nearest(stack(batch["vec"]), shared.value)
                yield batch

    return df.mapInPandas(assign, schema=f"{_fields(df)}, top long, reach double")


def _beside_inner(
    df: DataFrame, inner: DataFrame, plan: BlockPlan, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Applies `run` to slices of the rows of a first-level cell and the pivots inside that cell."""
    slices = df.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / (16 * plan.block_rows)).cast("int").alias("_slices"))
    rows = df.join(slices, "top").withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int"))
    points = inner.join(slices, "top").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    keys = ["top", "_slice"]
    return rows.drop("_slices").groupBy(*keys).cogroup(points.drop("_slices").groupBy(*keys)).applyInPandas(run, schema=schema)


def _inner_placed(placed: DataFrame, inner: DataFrame, plan: BlockPlan) -> DataFrame:
    columns = [c for c in placed.columns if c not in ("top", "reach")]

    def assign(batch: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if len(batch) == 0 or len(points) == 0:
            return pd.DataFrame(columns=[*columns, "home", "reach"])
        place, batch["reach"] = _nearest(stack(batch["vec"]), stack(points["vec"]))
        batch["home"] = points["home"].to_numpy()[place]
        return batch[[*columns, "home", "reach"]]

    schema = f"{_fields(placed.select(*columns))}, home long, reach double"
    return _beside_inner(placed, inner, plan, assign, schema)


def cell_index(corpus: DataFrame, plan: BlockPlan = DEFAULT_PLAN) -> CellIndex | None:
    """The cells of a corpus (id, vec, payload), or None where one cell is enough."""
    rows = corpus.count()
    top = pivots_of(corpus, rows, plan)
    if top is None:
        return None
    placed = materialize(_top_placed(corpus, top))
    low, high = np.full(len(top), np.inf), np.full(len(top), -np.inf)
    # At most one row per pivot comes back.
    for row in placed.groupBy("top").agg(F.min("reach").alias("lo"), F.max("reach").alias("hi")).collect():
        low[row["top"]], high[row["top"]] = row["lo"], row["hi"]
    if rows // plan.cell_rows <= plan.pivots:
        return CellIndex(plan, top, low, high, None, placed.withColumn("home", F.col("top")).drop("top", "reach"))
    wanted = placed.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / plan.cell_rows).alias("wanted"))
    picked = first_rows(placed.select("top", "id", "vec"), ["top"], [F.xxhash64("id"), F.col("id")], plan.pivots, "n")
    points = materialize(
        picked.join(wanted, "top").where("n <= wanted")
        .select("top", "vec", (F.col("top") * plan.pivots + F.col("n") - 1).alias("home"))
    )
    assigned = materialize(_inner_placed(placed, points, plan))
    reach = assigned.groupBy("home").agg(F.min("reach").alias("low"), F.max("reach").alias("high"))
    inner = materialize(points.join(reach, "home"))
    return CellIndex(plan, top, low, high, inner, assigned.drop("reach"))


def block_join(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    block: BlockFunction,
    schema: str,
    plan: BlockPlan = DEFAULT_PLAN,
    fold: Fold | None = None,
    defers: bool = False,
) -> DataFrame:
    """Applies `block` to every pair of blocks that can hold a pair with `dot >= threshold`.

    Both sides carry `id`, `vec` and any payload the block function wants. With `right=None` the
    left side is joined with itself and each unordered pair of rows meets exactly once; the block
    function tells such pairs apart with `meets_once`.
    """
    mirrored = right is None
    corpus = left if mirrored else right
    index = cell_index(corpus, plan)
    if index is None:
        lefts = left.withColumn("home", F.lit(0)).withColumn("cell", F.lit(0))
        rights = _renewed(corpus).withColumn("cell", F.lit(0))
    else:
        seekers = index.rows if mirrored else left.withColumn("home", F.lit(-1).cast("long"))
        visiting = index.visits(seekers.withColumn("radius", F.lit(_radius(threshold)))).drop("radius")
        # Two cells of one table meet once, from the smaller number.
        lefts = visiting.where("cell >= home") if mirrored else visiting
        rights = _renewed(index.rows).withColumnRenamed("home", "cell")
    return join_chunks(lefts, rights, block, schema, plan, fold=fold, defers=defers)


def _radius(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def keyed_block_join(
    left: DataFrame, right: DataFrame, block: BlockFunction, schema: str, plan: BlockPlan = DEFAULT_PLAN,
    products: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """Applies `block` to all blocks in which rows of equal `key` (a string) can meet.

    Keys are hashed into cells of about half a block, so that many small keys share a task, and a key
    with more rows than a block is cut into chunks on both sides. `same_key` tells pairs of one key.
    """
    cells = max(1, math.ceil(2 * right.count() / plan.block_rows))
    cell = F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")
    lefts, rights = left.withColumn("cell", cell), _renewed(right).withColumn("cell", cell)
    return join_chunks(lefts, rights, block, schema, plan, products=products)


def same_key(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> np.ndarray:
    """Matrix of pairs whose keys are equal, by the keys themselves."""
    codes = pd.factorize(np.concatenate([lpdf["key"].to_numpy(), rpdf["key"].to_numpy()]))[0]
    return codes[: len(lpdf), None] == codes[None, len(lpdf):]


def chunk_sizes(lefts: DataFrame, rights: DataFrame, plan: BlockPlan, grouped: bool) -> DataFrame:
    """Per cell that both sides share the numbers of its blocks and chunks: (cell, l_blocks, l_chunks, r_blocks, r_chunks).

    `grouped` puts blocks together in chunks; else each block is a chunk.
    """
    def counted(df: DataFrame, side: str) -> DataFrame:
        wide = F.max(F.size("vec")) if grouped else F.lit(0)
        return df.groupBy("cell").agg(F.count(F.lit(1)).alias(f"{side}_rows"), wide.alias(f"{side}_wide"))

    sizes = counted(lefts, "l").join(counted(rights, "r"), "cell")
    blocks = [F.ceil(F.col(f"{x}_rows") / plan.block_rows).cast("int").alias(f"{x}_blocks") for x in "lr"]
    if not grouped:
        return sizes.select("cell", *blocks).withColumns({"l_chunks": F.col("l_blocks"), "r_chunks": F.col("r_blocks")})
    held = F.floor(CHUNK_BYTES / (8 * F.greatest("l_wide", "r_wide", F.lit(1))))
    held = F.greatest(F.lit(plan.block_rows), F.least(F.lit(plan.chunk_rows), held))
    least = [F.ceil(F.col(f"{x}_rows") / held).cast("int").alias(f"{x}_least") for x in "lr"]
    sizes = materialize(sizes.select("cell", *blocks, *least))
    pairs = sizes.agg(F.sum(F.col("l_least").cast("double") * F.col("r_least")).alias("n")).head()["n"] or 1.0
    more = math.sqrt(max(1.0, PAIRS_PER_CORE * lefts.sparkSession.sparkContext.defaultParallelism / pairs))
    return sizes.select("cell", "l_blocks", "r_blocks", *[
        F.least(F.col(f"{x}_blocks"), F.ceil(F.col(f"{x}_least") * more).cast("int")).alias(f"{x}_chunks") for x in "lr"
    ])


def _blocks_of(rows: pd.DataFrame, column: str) -> list[pd.DataFrame]:
    ordered = rows.sort_values(column, kind="stable")
    starts = np.flatnonzero(np.diff(ordered[column].to_numpy(), prepend=-1))
    return [ordered.iloc[a:b].reset_index(drop=True) for a, b in zip(starts, [*starts[1:], len(ordered)])]


def join_chunks(
    lefts: DataFrame, rights: DataFrame, block: BlockFunction, schema: str, plan: BlockPlan, bans: DataFrame | None = None,
    products: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None, fold: Fold | None = None, defers: bool = False,
) -> DataFrame:
    """Cuts crowded cells into blocks on both sides and applies `block` to every pair of blocks.

    `bans` (cell, id of a right row, `banned` id of a left row) are pairs that do not count. Each goes to the
    one task where its rows meet, so neither row has a list that grows. `products` gives the dot products
    of two blocks that do not carry dense vectors.

    A task takes one pair of blocks, or with `fold` or `defers` one pair of chunks of many blocks: where
    `fold` keeps the results small, or the task `defers` the pairs of blocks that it has not got to after
    `plan.result_rows` results, which then are tasks of their own.
    """
    sizes = chunk_sizes(lefts, rights, plan, fold is not None or defers)
    number = lambda n, of="id": F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    chunk = lambda x, number: F.floor(number.cast("long") * F.col(f"{x}_chunks") / F.col(f"{x}_blocks")).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, counts = ["cell", "l_chunk", "r_chunk"], ["l_blocks", "r_blocks", "l_chunks", "r_chunks"]
    l_rows = lefts.join(sizes, "cell").withColumn("l_block", number("l_blocks"))
    r_rows = rights.join(sizes, "cell").withColumn("r_block", number("r_blocks"))
    l_sent = l_rows.withColumn("l_chunk", chunk("l", F.col("l_block"))).withColumn("r_chunk", spread("r_chunks"))
    r_sent = r_rows.withColumn("r_chunk", chunk("r", F.col("r_block"))).withColumn("l_chunk", spread("l_chunks"))

    if bans is not None:
        kind = f"array<{_type_of(bans, 'banned')}>"
        met = bans.join(sizes, "cell").select(
            "id", "cell", chunk("l", number("l_blocks", "banned")).alias("l_chunk"),
            chunk("r", number("r_blocks")).alias("r_chunk"), F.array("banned").alias("banned"),
        )
        r_sent = r_sent.withColumn("banned", F.array().cast(kind)).unionByName(met, allowMissingColumns=True)

    empty = [f.split()[0].strip("` ") for f in schema.split(",")]
    late = ["late_cell", "late_l", "late_r"]

    def blocks_met(lpdf: pd.DataFrame, rpdf: pd.DataFrame, most: int | None) -> pd.DataFrame:
        banned = None
        if "banned" in rpdf:
            real = rpdf["banned"].map(len) == 0
            banned, rpdf = rpdf[~real], rpdf[real].reset_index(drop=True)
        names = empty if most is None else [*empty, *late]
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame(columns=names)
        others = [(b, None if products else stack(b["vec"])) for b in _blocks_of(rpdf, "r_block")]
        found, rows, left_over = [], 0, []
        for mine in _blocks_of(lpdf, "l_block"):
            vectors, met = None if products else stack(mine["vec"]), []
            for other, matrix in others:
                if most is not None and rows > most:
                    left_over.append((mine["cell"].iloc[0], mine["l_block"].iloc[0], other["r_block"].iloc[0]))
                    continue
                dots = products(mine, other) if products else vectors @ matrix.T
                if banned is not None and len(banned):
                    pairs = pd.DataFrame({"left": [b[0] for b in banned["banned"]], "right": banned["id"].to_numpy()})
                    for side, ids in (("left", mine["id"]), ("right", other["id"])):
                        pairs = pairs.merge(pd.DataFrame({side: ids.to_numpy(), f"{side}_at": np.arange(len(ids))}), on=side)
                    dots[pairs["left_at"].to_numpy(dtype=int), pairs["right_at"].to_numpy(dtype=int)] = -np.inf
                told = block(mine, other, dots)
                if len(told):
                    met.append(told)
                    rows += len(told)
            if met:
                found.append(fold(pd.concat(met, ignore_index=True)) if fold and len(met) > 1 else pd.concat(met, ignore_index=True))
        if left_over:
            found.append(pd.DataFrame(left_over, columns=late))
        return pd.concat(found, ignore_index=True).reindex(columns=names) if found else pd.DataFrame(columns=names)

    def run(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        return blocks_met(lpdf, rpdf, None)

    def begin(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        return blocks_met(lpdf, rpdf, plan.result_rows)

    sent = l_sent.drop(*counts).groupBy(*keys).cogroup(r_sent.drop(*counts).groupBy(*keys))
    if not defers:
        return sent.applyInPandas(run, schema=schema)
    told = materialize(sent.applyInPandas(begin, schema=f"{schema}, late_cell long, late_l int, late_r int"))
    whole = told.where("late_cell is null").drop(*late)
    pairs = told.where("late_cell is not null").select(*[F.col(a).alias(b) for a, b in zip(late, ("cell", "l_block", "r_block"))])
    if pairs.isEmpty():
        return whole
    keys = ["cell", "l_block", "r_block"]
    alone = [side.drop(*counts).join(pairs, ["cell", own]).groupBy(*keys) for side, own in ((l_rows, "l_block"), (r_rows, "r_block"))]
    return whole.unionByName(alone[0].cogroup(alone[1]).applyInPandas(run, schema=schema))


def _renewed(df: DataFrame) -> DataFrame:
    """Same columns under new identities, so that a table can be grouped with itself."""
    return df.select(*[F.col(name).alias(name) for name in df.columns])


def meets_once(lpdf: pd.DataFrame, rpdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Keeps, of the candidate index pairs of a self join, each unordered pair once."""
    same_cell = lpdf["home"].to_numpy()[i] == rpdf["cell"].to_numpy()[j]
    lid, rid = lpdf["id"].to_numpy()[i], rpdf["id"].to_numpy()[j]
    return ~same_cell | (lid < rid)


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


# -- top-k -------------------------------------------------------------------------------------------


def _excluded(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> np.ndarray:
    """Takes out the pairs whose tag lists share a value, by one join of the listed values."""
    if "exclude" not in lpdf or "tags" not in rpdf:
        return dots
    listed = [
        pd.DataFrame({side: np.arange(len(column)), "tag": column.to_numpy()}).explode("tag").dropna()
        for side, column in (("i", lpdf["exclude"]), ("j", rpdf["tags"]))
    ]
    shared = listed[0].merge(listed[1], on="tag")
    dots[shared["i"].to_numpy(dtype=int), shared["j"].to_numpy(dtype=int)] = -np.inf
    return dots


def top_matches(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    min_similarity: float,
    plan: BlockPlan = DEFAULT_PLAN,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """The k most similar corpus rows of each query: (query_id, match_id, similarity, rank).

    Inputs carry `id` and unit `vec`. A corpus row is skipped when its optional `tags` array shares
    a value with the query's optional `exclude` array, or when `excluded` (query_id, match_id), of any
    length, lists the pair. Each block hands on at most k rows per query, so the final ranking sees k rows
    per query and block, never all pairs. A query looks into its home cell first; with k matches there, only
    cells that can hold a better one are visited.
    """

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        dots = _excluded(lpdf, rpdf, dots)
        keep = dots >= lpdf["least"].to_numpy()[:, None]
        if dots.shape[1] > k:
            kth = np.partition(dots, -k, axis=1)[:, -k]
            keep &= dots >= kth[:, None]
        i, j = np.nonzero(keep)
        found = pd.DataFrame({
            "query_id": lpdf["id"].to_numpy()[i],
            "match_id": rpdf["id"].to_numpy()[j],
            "similarity": dots[i, j],
        })
        return best(found)

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["query_id", "similarity", "match_id"], ascending=[True, False, True])
        return found.groupby("query_id", sort=False).head(k)

    def ranked(found: DataFrame) -> DataFrame:
        return first_rows(found, ["query_id"], [F.desc("similarity"), F.asc("match_id")], k)

    schema = f"query_id {_type_of(queries, 'id')}, match_id {_type_of(corpus, 'id')}, similarity double"
    seekers = queries.withColumn("least", F.lit(float(min_similarity)))
    index = cell_index(corpus, plan)
    rights = _renewed(corpus).withColumn("cell", F.lit(0)) if index is None else _renewed(index.rows).withColumnRenamed("home", "cell")
    bans = None
    if excluded is not None:
        pairs = excluded.select(F.col("match_id").alias("id"), F.col("query_id").alias("banned")).distinct()
        bans = materialize(pairs.join(rights.select("id", "cell"), "id").select("id", "cell", "banned"))
    if index is None:
        return ranked(join_chunks(seekers.withColumn("cell", F.lit(0)), rights, block, schema, plan, bans, fold=best))
    placed = materialize(index.place(seekers))
    at_home = join_chunks(placed.withColumn("cell", F.col("home")), rights, block, schema, plan, bans, fold=best)
    first = materialize(ranked(at_home).drop("rank"))
    others = index.visits(narrowed(placed, first, k)).where("cell <> home").drop("home", "radius")
    return ranked(first.unionByName(join_chunks(others, rights, block, schema, plan, bans, fold=best)))


def narrowed(placed: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Seekers with the least similarity that can still enter their k best, and the radius of that."""
    full = first.groupBy(F.col("query_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_kth")
    ).where(F.col("_n") >= k).drop("_n")
    least = F.greatest("least", F.coalesce("_kth", "least"))
    known = placed.join(full, "id", "left").withColumn("least", least).drop("_kth")
    return known.withColumn("radius", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))))


# -- threshold pairs -----------------------------------------------------------------------------------


def similar_pairs(vectors: DataFrame, threshold: float, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Each unordered pair with similarity >= threshold once: (id_a, id_b, similarity), id_a < id_b."""

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(dots >= threshold)
        once = meets_once(lpdf, rpdf, i, j)
        i, j = i[once], j[once]
        a, b = lpdf["id"].to_numpy()[i], rpdf["id"].to_numpy()[j]
        swap = a > b
        return pd.DataFrame({
            "id_a": np.where(swap, b, a), "id_b": np.where(swap, a, b), "similarity": dots[i, j],
        })

    kind = _type_of(vectors, "id")
    return block_join(vectors, None, threshold, block, f"id_a {kind}, id_b {kind}, similarity double", plan, defers=True)


def copy_code(vec: Column, own: Column) -> Column:
    """Equal for equal vectors; zero vectors get one of their own each."""
    zero = ~F.exists(vec, lambda x: x != 0)
    return F.when(zero, F.concat(F.lit("zero:"), own.cast("string"))).otherwise(F.sha2(F.to_json(vec), 256))


def fold_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives of equal vectors and the copy table (id, rep_id).

    The smallest id represents its group, so a vector shared by a third of all rows costs one row
    in every similarity join; the copy table keeps the result whole. Zero vectors are similar to
    nothing, themselves included, so each of them stands alone.
    """
    hashed = vectors.select("id", "vec").withColumn("code", copy_code(F.col("vec"), F.col("id")))
    reps = hashed.groupBy("code").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))
    copies = hashed.select("id", "code").join(reps.select("code", "rep_id"), "code").select("id", "rep_id")
    payload = vectors.join(reps.select(F.col("rep_id").alias("id"), "copies"), "id")
    return payload, copies


def duplicate_pairs(
    vectors: DataFrame, threshold: float, plan: BlockPlan = DEFAULT_PLAN, folded: bool = True
) -> DataFrame:
    """Similar pairs in whole: (id_a, id_b, similarity, kind), linear in the copies of a vector.

    Kind `similar` pairs representatives (the smallest id of equal vectors); kind `copy` ties every
    further copy (id_b) to its representative (id_a). Together they stand for all pairs of similar
    rows: any two members of two similar groups, and any two of one group; `expand_pairs` writes
    them out.

    Without `folded` every pair of similar rows is a row of its own, copies among them, all of kind `similar`;
    rows of one id are no pair.
    """
    vectors = materialize(vectors.select("id", "vec"))
    if not folded:
        every = similar_pairs(vectors.where("id is not null"), threshold, plan)
        return every.where("id_a < id_b").withColumn("kind", F.lit("similar"))
    reps, copies = fold_copies(vectors)
    links = copies.where(F.col("id") != F.col("rep_id")).select(
        F.col("rep_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind")
    )
    near = similar_pairs(reps.select("id", "vec"), threshold, plan).withColumn("kind", F.lit("similar"))
    return near.unionByName(links)


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of a `duplicate_pairs` result; quadratic in the copies, for small groups."""
    copies = pairs.where("kind = 'copy'").select(F.col("id_a").alias("rep"), F.col("id_b").alias("id"))
    members = copies.unionByName(copies.select("rep", F.col("rep").alias("id"))).distinct()
    lone = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(members, "id", "left_anti")
    members = members.unionByName(lone.select(F.col("id").alias("rep"), "id"))
    left, right = (members.select(F.col("rep").alias(f"id_{x}"), F.col("id").alias(f"member_{x}")) for x in "ab")
    near = pairs.where("kind = 'similar'").join(left, "id_a").join(right, "id_b").select("member_a", "member_b", "similarity")
    inside = left.join(right.withColumnRenamed("id_b", "id_a"), "id_a").where("member_a < member_b").select(
        "member_a", "member_b", F.lit(1.0).alias("similarity")
    )
    a, b = F.least("member_a", "member_b"), F.greatest("member_a", "member_b")
    return near.unionByName(inside).select(a.alias("id_a"), b.alias("id_b"), "similarity")


# -- aggregates over the threshold graph, without its edges -------------------------------------------------


def neighbour_counts(vectors: DataFrame, threshold: float, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Rows with similarity >= threshold per row, itself excluded: (id, neighbours).

    An optional `weight` column (copies of a vector) is counted in full.
    """
    weighted = "weight" in vectors.columns

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(dots >= threshold)
        once = meets_once(lpdf, rpdf, i, j)
        i, j = i[once], j[once]
        lw = lpdf["weight"].to_numpy() if weighted else np.ones(len(lpdf))
        rw = rpdf["weight"].to_numpy() if weighted else np.ones(len(rpdf))
        ids = np.concatenate([lpdf["id"].to_numpy(), rpdf["id"].to_numpy()])
        seen = np.concatenate([
            np.bincount(i, weights=rw[j], minlength=len(lpdf)),
            np.bincount(j, weights=lw[i], minlength=len(rpdf)),
        ])
        hit = seen > 0
        return pd.DataFrame({"id": ids[hit], "neighbours": seen[hit].astype("int64")})

    schema = f"id {_type_of(vectors, 'id')}, neighbours bigint"
    together = lambda found: found.groupby("id", as_index=False).sum()
    partial = block_join(vectors, None, threshold, block, schema, plan, together)
    return partial.groupBy("id").agg(F.sum("neighbours").alias("neighbours"))


def spanning_edges(vectors: DataFrame, threshold: float, plan: BlockPlan = DEFAULT_PLAN) -> DataFrame:
    """Edges (id_a, id_b) that connect exactly what the threshold graph connects.

    A block emits one star per connected component it sees, at most one edge per row, so a dense
    group of n rows yields about n edges per block instead of n * n.
    """

    def block(lpdf: pd.DataFrame, rpdf: pd.DataFrame, dots: np.ndarray) -> pd.DataFrame:
        adjacent = dots >= threshold
        lid, rid = lpdf["id"].to_numpy(), rpdf["id"].to_numpy()
        seen_l = np.zeros(len(lid), dtype=bool)
        seen_r = np.zeros(len(rid), dtype=bool)
        tails, heads = [], []
        for start in range(len(lid)):
            if seen_l[start]:
                continue
            seen_l[start] = True
            frontier = np.array([start])
            while len(frontier):
                right_new = np.nonzero(adjacent[frontier].any(axis=0) & ~seen_r)[0]
                seen_r[right_new] = True
                heads.extend(rid[right_new])
                tails.extend([lid[start]] * len(right_new))
                if not len(right_new):
                    break
                left_new = np.nonzero(adjacent[:, right_new].any(axis=1) & ~seen_l)[0]
                seen_l[left_new] = True
                heads.extend(lid[left_new])
                tails.extend([lid[start]] * len(left_new))
                frontier = left_new
        edges = pd.DataFrame({"id_a": tails, "id_b": heads})
        return edges[edges["id_a"] != edges["id_b"]]

    kind = _type_of(vectors, "id")
    once = lambda found: found.drop_duplicates()
    return block_join(vectors, None, threshold, block, f"id_a {kind}, id_b {kind}", plan, once).distinct()
