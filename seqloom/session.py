"""What a Spark session needs to run this package's Python code on executors."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application.

    Where the workers' PYTHONPATH has it already nothing is sent."""
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    files = sorted(p for p in _ROOT.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{_ROOT.name}-{mark}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all runs in one process (tests) one of our own."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = place or tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder there, for tables that are written and read again."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df, laid_out: bool = False):
    """Computes df once into the folder of spark.checkpoint.dir and cuts its lineage there.

    laid_out: partitioning and order stay known, so that what reads it needs no further
    shuffle or sort by the same keys (a plan that is adapted while it runs forgets them)."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    if not laid_out:
        return df.checkpoint(eager=True)
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)
