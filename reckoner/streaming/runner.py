"""Continuous runs: the batch functions, applied to each micro-batch, with writes that can be repeated. Keyed tables are in keyed.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, once: bool = True):
    """Each micro-batch goes through transform and to its own partition of folder, `batch_id`; a batch that is repeated after a failure overwrites its partition, so every record is there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="10 seconds")).start()


def index_entries(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Index entries out of JSON messages; those that don't parse have a null id and keep their text."""
    return messages.withColumn("_entry", F.from_json(F.col(value).cast("string"), schema, {"mode": "PERMISSIVE"})).select(F.col(value).alias("raw"), "_entry.*")
