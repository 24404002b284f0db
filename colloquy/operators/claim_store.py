"""Claims on disk under the cell of their vector, read by the cells that a batch can reach.

The pivots of a generation stay as they were chosen, so a batch is appended without touching what is there;
`rebuild` chooses new pivots for a store that has outgrown its own, as a new generation with a pointer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.similarity import DEFAULT_PLAN, BlockPlan, CellIndex, pivots_of, stack, unit_vectors
from colloquy.session import discard, materialize

#: Cell of claims without a vector; no similarity reaches it.
NOWHERE = -1


@dataclass(frozen=True)
class ClaimStore:
    """Claims (claim_id, embedding, ...) under `path`, appended in numbered batches."""

    path: str
    plan: BlockPlan = DEFAULT_PLAN

    def _generation(self, spark: SparkSession) -> str:
        pointers = spark.read.schema("generation int").json(f"{self.path}/_generations")
        return f"{self.path}/generation={pointers.agg(F.max('generation').alias('g')).head()['g']}"

    def create(self, claims: DataFrame, generation: int = 0) -> ClaimStore:
        """Starts a generation with pivots from these claims and the claims as batch 0."""
        spark = claims.sparkSession
        claims = materialize(claims)
        vectors = unit_vectors(claims.withColumn("id", F.col("claim_id"))).select("id", "vec")
        points = pivots_of(vectors, vectors.count(), self.plan)
        rows = [] if points is None else [(n, [float(x) for x in p]) for n, p in enumerate(points)]
        folder = f"{self.path}/generation={generation}"
        spark.createDataFrame(rows, "n int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/pivots")
        self._append(folder, claims, 0)
        pointer = spark.createDataFrame([(generation,)], "generation int").coalesce(1)
        pointer.write.mode("overwrite").json(f"{self.path}/_generations/number={generation}")
        discard(claims)
        return self

    def rebuild(self, spark: SparkSession) -> ClaimStore:
        """A new generation with pivots for what the store holds now; its claims become batch 0."""
        generation = int(self._generation(spark).rsplit("=", 1)[1])
        return self.create(self.read(spark), generation + 1)

    def append(self, claims: DataFrame, batch: int) -> None:
        """Adds claims as a batch above 0; a repeated batch replaces itself."""
        self._append(self._generation(claims.sparkSession), claims, batch)

    def _append(self, folder: str, claims: DataFrame, batch: int) -> None:
        spark = claims.sparkSession
        points = self._points(spark, folder)
        placed = unit_vectors(claims.withColumn("id", F.col("claim_id"))).select("id", "vec")
        if len(points) < 2:
            placed = placed.select("id", F.lit(0).cast("long").alias("home"), F.lit(0.0).alias("reach"))
        else:
            index = CellIndex(self.plan, points, np.zeros(0), np.zeros(0), None, placed)
            placed = index.place(placed, keep_reach=True).select("id", "home", "reach")
        placed = materialize(placed.withColumnRenamed("id", "claim_id").dropDuplicates(["claim_id"]))
        # A crowded cell is written by as many tasks as it has pieces; one row per cell is counted.
        pieces = placed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / self.plan.cell_rows).alias("pieces"))
        piece = F.pmod(F.xxhash64("claim_id"), F.coalesce("pieces", F.lit(16)))
        cell = F.coalesce("home", F.lit(NOWHERE)).cast("int").alias("cell")
        rows = claims.join(placed, "claim_id", "left").join(F.broadcast(pieces), "home", "left")
        rows = rows.select(*[F.col(c) for c in claims.columns], cell, piece.alias("piece")).repartition("cell", "piece").drop("piece")
        rows.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows/batch={batch}")
        reach = placed.groupBy(F.col("home").alias("cell")).agg(F.min("reach").alias("low"), F.max("reach").alias("high"))
        reach.coalesce(1).write.mode("overwrite").parquet(f"{folder}/reach/batch={batch}")
        discard(placed)

    def _points(self, spark: SparkSession, folder: str) -> np.ndarray:
        return stack(spark.read.parquet(f"{folder}/pivots").orderBy("n").toPandas()["vec"])

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All claims, or those of the batches below a number."""
        rows = spark.read.option("basePath", f"{self._generation(spark)}/rows").parquet(f"{self._generation(spark)}/rows")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.drop("batch", "cell")

    def near(self, claims: DataFrame, min_similarity: float, before: int | None = None) -> DataFrame:
        """The claims of all cells that can hold one at least that similar to any of these claims.

        Files of other cells are not read. At most one number per pivot comes to the driver.
        """
        spark = claims.sparkSession
        folder = self._generation(spark)
        rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        cells = self.cells_near(claims, min_similarity, before)
        return rows.where(F.col("cell").isin(cells)).drop("batch", "cell")

    def cells_near(self, claims: DataFrame, min_similarity: float, before: int | None = None) -> list[int]:
        spark = claims.sparkSession
        folder = self._generation(spark)
        points = self._points(spark, folder)
        if len(points) < 2:
            return [0]
        try:
            reach = spark.read.parquet(f"{folder}/reach")
        except AnalysisException:
            return []
        reach = reach if before is None else reach.where(F.col("batch") < before)
        low, high = np.full(len(points), np.inf), np.full(len(points), -np.inf)
        for row in reach.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            low[row["cell"]], high[row["cell"]] = row["low"], row["high"]
        seekers = unit_vectors(claims.withColumn("id", F.col("claim_id"))).select("id", "vec")
        radius = math.sqrt(max(0.0, 2 - 2 * min_similarity))
        index = CellIndex(self.plan, points, low, high, None, seekers)
        visited = index.visits(seekers.withColumn("radius", F.lit(radius))).select("cell").distinct()
        return sorted(r["cell"] for r in visited.collect())
