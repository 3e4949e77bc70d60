"""Session and checkpoint helpers shared by every job."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder, the cluster's ``spark.checkpoint.dir``. Where it is unset a local session gets a
    temporary one; on a cluster, whose executors don't share such a folder, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again. Unlike a checkpoint this gives the plan the true size of
    its input; in a loop of joins, sizes estimated from estimates would grow beyond all bounds. The shuffles that made it are
    let go, so a job of many steps holds the disk of one."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # Spark deletes shuffles whose plans the driver has collected
    return df.sparkSession.read.parquet(path)
