"""Resolving a stream of queries against a fixed table of targets.

Each micro-batch runs the batch plan; both outputs of a batch are written before it is committed, under a folder named by
the batch, so a batch that is run again replaces its own output and nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def resolve_stream(queries: DataFrame, resolve: Callable[[DataFrame], tuple[DataFrame, DataFrame]], folder: str, checkpoint: str) -> StreamingQuery:
    """Start the stream. resolve: a batch of queries to (matches, candidates), one row for each query."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for name, out in zip(("matches", "candidates"), resolve(rows)):
                out.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            rows.unpersist()

    return queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
