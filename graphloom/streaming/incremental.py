"""Incremental loading: a stream of node rows is upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..operators.lineage import checkpointed
from ..plans.store import Store


def upsert_stream(nodes: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of the streaming nodes replaces the rows of its ids in the store; a repeated batch changes nothing.

    Only the parts of the table that hold a batch's ids are written again, and one log file makes them valid.
    """

    def load(batch: DataFrame, _: int) -> None:
        tables = Store(batch.sparkSession, store)
        before = tables.current()
        after = tables.merged(before, "nodes", graph.validated(checkpointed(batch)), lambda a, b: graph.upsert_nodes(a, b).drop("turn"))
        if after != before:
            tables.commit(before, after)

    return nodes.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
