"""Session defaults, checkpointing and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "colloquy", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own session instead."""
    partitions = str(cores if cores != "*" else os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; make a local one only for local masters."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="colloquy-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed inside deletes its shuffle files when it ends.

    Else they stay until the driver happens to collect its garbage, and the steps of a job pile up on the disks.
    """
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_SETTING)
        else:
            spark.conf.set(_CLEANUP_SETTING, before)


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes the rows to a table in the shared checkpoint folder and reads them back.

    The lineage ends there, so iterations survive the loss of executors. A plain `checkpoint()`
    keeps the constraints of the plan it came from, which makes planning time grow exponentially
    over the rounds of an iterative job; a table carries none.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing will read any more, such as those of past rounds."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path is not None:
            jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that very long texts do not meet in one batch by the thousand.

    A session with a smaller limit keeps it.
    """
    limit = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


class Ledger:
    """A table in the checkpoint folder that rounds of an iteration add to; every row is written once."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.path, self.parts = spark, f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the rows as the next part and returns that part."""
        path = f"{self.path}/part={self.parts}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        self.parts += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def rows(self) -> DataFrame:
        """All parts (one at least) as one scan."""
        return self.spark.read.parquet(self.path).drop("part")


def read_table(spark: SparkSession, base: str, name: str, spread: bool = False) -> DataFrame:
    """Scan of a table; `spread` is for work that is heavy per row.

    A table stored in fewer pieces than there are cores would keep the others idle, so such a scan
    is redistributed. A table of many files is left alone.
    """
    table = spark.read.parquet(os.path.join(base, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    if spread and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
