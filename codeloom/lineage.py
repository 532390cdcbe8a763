"""Cutting lineage and spreading work, for all parts of the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; only where none is named (tests), a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage is cut and it outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: its lineage is cut and it outlives executors, as
    with ``checkpointed``, but columns are compressed and read one by one."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, target_bytes: int = 128 << 20) -> int:
    """As many partitions as the optimiser's estimate of the size asks for, at least the session's number for shuffles, which is
    also taken where the size is not known."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 60 else max(least, min(size // target_bytes + 1, 50_000))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: one more exchange, only where a scan has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def fenced(df: DataFrame, keep: list[str], made: list[str]) -> DataFrame:
    """``keep`` and ``made`` of ``df``. The made columns pass through a generator, so that filters on them, also those that
    joins infer, are not pushed below and the expressions computed again for each."""
    return df.select(*keep, F.explode(F.array(F.struct(*made))).alias("_made")).select(*keep, *[F.col(f"_made.{c}").alias(c) for c in made])
