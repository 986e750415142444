"""Row batches over streams: every micro-batch goes through the same plans as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.batch import Batch
from rowloom.operators import projection
from rowloom.plans.model import Schema


def project_stream(rows: DataFrame, schema: Schema, name: str) -> DataFrame:
    """A projection of a stream of physical rows; it needs no state."""
    return projection.project(rows, schema, name, "batch_id", "pos")


def logical_stream(rows: DataFrame, schema: Schema) -> DataFrame:
    return projection.logical(rows, schema, "batch_id", "pos")


def each_batch(rows: DataFrame, schema: Schema, work: Callable[[Batch, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """work(batch, epoch) for each micro-batch of a stream of physical rows.

    A micro-batch may come again after a failure; work must write what a second run replaces, for
    instance under a folder named by the epoch.
    """
    writer = rows.writeStream.foreachBatch(lambda df, epoch: work(Batch(df, schema), epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def encode_to(folder: str, cap: int | None = None, trusted: bool = False) -> Callable[[Batch, int], None]:
    """Work for each_batch: encoded batches as Parquet under folder/epoch=N."""

    def work(batch: Batch, epoch: int) -> None:
        encoded = batch.encode(cap, trusted).withColumn("epoch", F.lit(epoch))
        encoded.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return work
