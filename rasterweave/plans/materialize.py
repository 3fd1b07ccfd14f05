"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests, a local one of this session. A cluster without one is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rasterweave-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/rasterweave-{name}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """frame, computed once into the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
