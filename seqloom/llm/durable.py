"""Intermediate results that outlive executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and all runs in one process (tests) a folder of our own."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = place or tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place


def settle(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder and cuts its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
