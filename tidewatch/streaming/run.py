"""Starting streams with a file sink, and running them until their input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.session import shared_path


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def to_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet; the sink's log makes each batch visible exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    """Hand every micro-batch to `handle`, which must give the same result when a batch comes again."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to the end of its present input and return what it emitted."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    to_files(stream, path, shared_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
