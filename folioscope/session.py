"""Session helpers: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    It is the one the cluster names in spark.checkpoint.dir. Only where that is unset, as in tests on
    one machine, a temporary folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget how it was made; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path for a written table in the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def parallelism(spark: SparkSession) -> int:
    """Task slots to plan for: the larger of the default parallelism and the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
