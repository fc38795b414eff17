"""Documents as a stream: each micro-batch is one insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.plans.engine import Engine


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Insert every micro-batch of (content). The tables of documents and chunks are the state, so a batch that is run again adds nothing."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: engine.insert(batch.select("content")))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
