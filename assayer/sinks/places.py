"""Folders for what queries write on their way."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir). In local mode, where none is named, one of this
    machine; on a cluster that names none this fails."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        top = tempfile.mkdtemp(prefix="assayer-")
    parts = urlparse(top)
    top = parts.path if parts.scheme == "file" else top
    folder = f"{top}/{name}-{uuid.uuid4()}"
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster shares: rows of a round survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
