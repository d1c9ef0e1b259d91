"""Small helpers around the running session: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir; only a local session without one gets a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    context.setCheckpointDir(named or local_folder(spark, "notelake-checkpoint-"))


def local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder, for sessions whose tasks run in this process; a cluster must name a shared one."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder once and returns the stored rows; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reclaim(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that are no longer referred to, typically after :func:`cut_lineage`.

    Spark removes them once the driver collects its garbage, which may be long after the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(rows: int, per_partition: int, least: int = 1) -> int:
    """How many shuffle partitions hold ``rows`` at ``per_partition`` rows each."""
    return max(least, -(-rows // per_partition))


def default_parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Adds a broadcast hint only after counting that ``df`` has at most ``max_rows`` rows; else leaves the join to Spark."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def broadcast_if_bounded(df: DataFrame, bound: int, max_rows: int) -> DataFrame:
    """Adds a broadcast hint if ``bound``, a proven upper limit of the rows of ``df``, is at most ``max_rows``."""
    return F.broadcast(df) if bound <= max_rows else df


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the place of each row in this order, from 1.

    Rows are range-partitioned and numbered inside their partition; only a count per partition is summed up.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(out, local + F.col("_before") + 1).drop("_p", "_id", "_before")
