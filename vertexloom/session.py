"""Session helpers: checkpoint folder, table access, plan truncation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; that value is used as it is. Where the
    setting is absent a temporary folder is made, and only in local mode: on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured and not current:  # set after the context was made
        spark.sparkContext.setCheckpointDir(configured)
    if configured or current:
        return configured or current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its table is one file, for work that costs far more than a shuffle.

    A small file often has one row group and would be one task. Tables of several files stay as they
    are: their splits are enough, and moving them is not free.
    """
    if len(df.inputFiles()) > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
