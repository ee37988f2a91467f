"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir``; only a session on one machine can do without that setting."""
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="ledgerlens-")
        context.setCheckpointDir(root)
    return root
