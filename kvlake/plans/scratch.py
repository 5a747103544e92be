"""A folder that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; only where that is unset, beside the warehouse."""
    _ensure(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4()}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: rows numbered by their partition stay as they are, whatever the
    planner does later and whichever executor is lost."""
    _ensure(df.sparkSession)
    return df.checkpoint()


def _ensure(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
