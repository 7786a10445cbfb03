"""Streams into collections and streams of queries against them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.exact import knn
from ..sources.collection import Collections


def insert_stream(stream: DataFrame, collections: Collections, name: str, checkpoint: str, flush: bool = True, once: bool = True) -> StreamingQuery:
    """Inserts each micro-batch; rows are found after the flush.

    The batch's number is committed with its rows in one step, so a batch that is replayed after a crash anywhere is not
    inserted twice, and what followed the insert is done again. A collection that was purged or imported forgets its batches.
    """
    key = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        if not batch.limit(1).count():
            return
        collections.insert(name, batch, (key, number))
        if flush:
            collections.flush(name)

    writer = stream.writeStream.queryName(f"insert_{name}_{key}").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def search_stream(queries: DataFrame, base: DataFrame, k: int, sink, checkpoint: str, metric: str = "l2") -> StreamingQuery:
    """Answers each micro-batch of (id, vec) queries by exact search; sink(result, batch number)."""
    writer = queries.writeStream.foreachBatch(lambda batch, n: sink(knn(batch, base, k, metric), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
