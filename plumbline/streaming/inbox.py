"""A watched folder of catalogue files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*", once: bool = False) -> StreamingQuery:
    """Each new file (path, modificationTime, length, content) reaches `handle` in a batch exactly once a checkpoint."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", glob).load(folder)
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
