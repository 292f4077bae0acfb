"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hits that are broadcast to the rows they name, at most.
BROADCAST_HITS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """This session's part of spark.checkpoint.dir; of a temporary folder only in a local session that sets none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvine-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(hits: DataFrame) -> DataFrame:
    """Checkpointed, and broadcast where it has no more than BROADCAST_HITS rows: else what it meets is sorted and shuffled whole."""
    hits = cut(hits)
    return F.broadcast(hits) if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else hits
