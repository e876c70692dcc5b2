"""Incremental linkage of new pool records, as a stream. An extension: batch operators serve each micro-batch."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(arrivals: DataFrame, entities: DataFrame, link: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Link each micro-batch of arriving records to the entities and append the pairs, by batch, under path.

    A batch that is run again after a failure overwrites its own folder, so its pairs are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        link(entities, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
