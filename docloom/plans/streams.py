"""A given table as a stream, and a stream run until all of it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.scratch import new_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def as_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as they arrive; the schema is that of the table.

    The path is a pattern, which a stream reads whether it names a file or a directory.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def streamed(stream: DataFrame, start: Callable | None = None):
    """Runs a stream over what is there. The rows it has written, or the folder if ``start(stream, folder)`` writes."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if start is not None:
        start(stream, folder).awaitTermination()
        return folder
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
