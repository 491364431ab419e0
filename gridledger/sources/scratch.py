"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's address in spark.checkpoint.dir; in a local session without one, in a folder of this process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc._jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='gridledger-')).rstrip('/')}/{what}-{uuid.uuid4().hex}"
