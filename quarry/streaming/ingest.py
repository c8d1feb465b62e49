"""Incremental ingest: a stream of pages into the store, a segment per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.catalog import Store


def ingest_stream(pages: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds each micro-batch of (page_id, url, html); a batch that is repeated after a failure finds its digests known."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest_pages(batch)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
