"""Corpora that keep arriving: new documents are chunked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corvine.operators.chunking import window_chunks
from corvine.sources.files import CORPUS


def documents(spark: SparkSession, folder: str, schema: str = CORPUS, files_at_once: int = 1000) -> DataFrame:
    """JSON lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def chunk_stream(docs: DataFrame, out: str, state: str, size: int = 60, stride: int = 45) -> StreamingQuery:
    """Windows of every new document, appended to Parquet exactly once; ends when what has arrived is done."""
    return window_chunks(docs, size, stride).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
