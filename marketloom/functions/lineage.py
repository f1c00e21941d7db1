"""Reliable checkpoints and tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, as in tests, under one of our own. A cluster must set it."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if place is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        place = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return f"{place}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession, "unused")
    return df.checkpoint(eager=True)
