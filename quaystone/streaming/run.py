"""Runs a stream over what is there now and gives the result as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quaystone.session import shared_folder


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The output of stream once all its present input is processed. Files and
    checkpoint go to the shared folder of spark.checkpoint.dir."""
    spark = stream.sparkSession
    at = shared_folder(spark, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], once: bool = True, checkpoint: str | None = None) -> None:
    """Hands every micro-batch of stream, with its number, to handle: all that
    is there now, or until stopped. A batch that is handed again after a
    failure has the same number. With a checkpoint, a later call goes on after
    the last batch of an earlier one; without, it begins anew."""
    at = checkpoint or f"{shared_folder(stream.sparkSession, 'stream')}/checkpoint"
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", at)
    (writer.trigger(availableNow=True) if once else writer).start().awaitTermination()


def append_batches(stream: DataFrame, path: str, once: bool = True) -> None:
    """Appends the rows of stream to the table at path, each batch in a folder
    of its own number, so that one that is handed again replaces itself. The
    checkpoint lies beside them: a later call appends what came since."""
    each_batch(stream, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}"), once, f"{path}/_checkpoint")
