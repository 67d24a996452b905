"""Cutting a plan's lineage where a loop would double it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, in the checkpoint folder that all executors share (``spark.checkpoint.dir``).

    Where that is unset and all runs in one process (``local[...]``), a local folder takes its place; elsewhere
    that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir", None)
        if not root and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """df as a local relation, for results that their operator bounds to a few dozen rows (such as top-k)."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
