"""Tables between the steps of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled_table(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the folder that the cluster names, so that lineage ends there and lost executors do no harm."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/gistmill-checkpoints")
    return df.checkpoint()
